"""Brute-force text scores that the native ones are tested against (M5-M7), from the
published algorithms: the Porter stemmer (1980, with the common extension
rules), ROUGE-1 / ROUGE-L F-measure (Lin, 2004) and METEOR's exact + stem
alignment with its fragmentation penalty (Banerjee & Lavie, 2005).  The
WordNet synonym stage of METEOR is not available offline; an optional
synonym map can be passed instead.
"""

from __future__ import annotations

import re
from collections import Counter

_VOWELS = set("aeiou")
# irregular forms kept by the extended stemmer
_IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
              "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
              "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
              "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def _cons(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    if w[i] == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        c = _cons(stem, i)
        if c and prev_vowel:
            m += 1
        prev_vowel = not c
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) >= 3 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1):
        return w[-1] not in "wxy"
    return len(w) == 2 and not _cons(w, 0) and _cons(w, 1)


def _rules(w: str, rules) -> str:
    for suffix, repl, cond in rules:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + repl if cond(stem) else w
    return w


def _m_gt(n):
    return lambda s: _measure(s) > n


_STEP2 = [(s, r, _m_gt(0)) for s, r in [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful")]]
_STEP3 = [(s, r, _m_gt(0)) for s, r in [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]]
_STEP4 = [(s, "", _m_gt(1)) for s in [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent"]] + \
    [("ion", "", lambda s: _measure(s) > 1 and s[-1:] in ("s", "t"))] + \
    [(s, "", _m_gt(1)) for s in ["ou", "ism", "ate", "iti", "ous", "ive", "ize"]]


_STEMS: dict[str, str] = {}  # per-worker cache (a plain dict ships with the code)


def porter_stem(word: str) -> str:
    hit = _STEMS.get(word)
    if hit is None:
        hit = _stem(word)
        if len(_STEMS) < 200_000:
            _STEMS[word] = hit
    return hit


def _stem(word: str) -> str:
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("ied"):
        w = w[:-3] + ("ie" if len(w) == 4 else "i")
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suf in ("ed", "ing"):
            if w.endswith(suf) and _has_vowel(w[: -len(suf)]):
                w = w[: -len(suf)]
                extra = True
                break
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        w = w[:-1] + "i"
    # step 2; the extensions: "alli" first, and the step again; the l of "logi" counts as stem
    while w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    w = w[:-1] if w.endswith("logi") and _measure(w[:-3]) > 0 else _rules(w, _STEP2)
    w = _rules(w, _STEP3)
    w = _rules(w, _STEP4)
    # step 5
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


def rouge_tokens(text: str) -> list[str]:
    """ROUGE tokenisation: lower, non-alphanumerics -> space, stem tokens longer than 3."""
    toks = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return [porter_stem(t) if len(t) > 3 else t for t in toks]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyrö 2004):
    O(len(b)) big-integer steps instead of an O(len(a)·len(b)) table."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _f(p: float, r: float) -> float:
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def rouge_1_l(target: str, prediction: str) -> tuple[float, float]:
    """ROUGE-1 and ROUGE-L F-measures (both symmetric in their arguments)."""
    t, p = rouge_tokens(target), rouge_tokens(prediction)
    if not t or not p:
        return 0.0, 0.0
    overlap = sum((Counter(t) & Counter(p)).values())
    r1 = _f(overlap / len(p), overlap / len(t))
    lcs = lcs_length(t, p)
    rl = _f(lcs / len(p), lcs / len(t))
    return r1, rl


def _match(hyp: list[tuple[int, str]], ref: list[tuple[int, str]]):
    """Pair equal words, both from the end; matched words leave.  Linear: the
    places of each word of ``ref`` are a stack."""
    places: dict[str, list[int]] = {}
    for j, (_, w) in enumerate(ref):
        places.setdefault(w, []).append(j)
    pairs, left, used = [], [], set()
    for i, w in reversed(hyp):
        stack = places.get(w)
        if stack:
            j = stack.pop()
            used.add(j)
            pairs.append((i, ref[j][0]))
        else:
            left.append((i, w))
    hyp[:] = left[::-1]
    ref[:] = [r for j, r in enumerate(ref) if j not in used]
    return pairs


def meteor(reference: str, candidate: str, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5,
           synonyms: dict[str, set[str]] | None = None) -> float:
    """METEOR of a candidate against one reference (whitespace tokens, lower
    case): exact, then stem, then (optional) synonym matches; F-mean with
    recall weight ``alpha`` and the chunk penalty ``gamma * (chunks/m)**beta``."""
    hyp = list(enumerate(w.lower() for w in candidate.split()))
    ref = list(enumerate(w.lower() for w in reference.split()))
    n_hyp, n_ref = len(hyp), len(ref)
    matches = _match(hyp, ref)
    sh = [(i, porter_stem(w)) for i, w in hyp]
    sr = [(j, porter_stem(w)) for j, w in ref]
    stem_pairs = _match(sh, sr)
    matches += stem_pairs
    if synonyms:
        left_h = {i for i, _ in sh}
        left_r = {j for j, _ in sr}
        hyp_left = [(i, w) for i, w in hyp if i in left_h]
        ref_left = [(j, w) for j, w in ref if j in left_r]
        for i, w in list(hyp_left)[::-1]:
            syn = synonyms.get(w, set()) | {w}
            for k in range(len(ref_left))[::-1]:
                if ref_left[k][1] in syn:
                    matches.append((i, ref_left[k][0]))
                    ref_left.pop(k)
                    break
    m = len(matches)
    if m == 0 or n_hyp == 0 or n_ref == 0:
        return 0.0
    matches.sort()
    chunks, i = 1, 0
    while i < m - 1:
        if matches[i + 1][0] == matches[i][0] + 1 and matches[i + 1][1] == matches[i][1] + 1:
            i += 1
            continue
        i += 1
        chunks += 1
    p, r = m / n_hyp, m / n_ref
    fmean = p * r / (alpha * p + (1 - alpha) * r)
    return (1 - gamma * (chunks / m) ** beta) * fmean
