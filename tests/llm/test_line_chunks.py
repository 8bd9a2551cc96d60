"""Line chunks against plain Python: their bounds, what is removed, and how many planted passages are found."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kvlens.llm import line_dedup, textcodes


def say(r, n, letters="abcdefghij"):
    return " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))


def lines_of(text):
    x = line_dedup.Lines(pa.array([text]))
    return [x.line(i) for i in range(len(x.words))], x.words.tolist()


def plain_chunks(text, min_words):
    """(lines, first line) of every chunk, one line after the other."""
    lines, words = lines_of(text)
    span = 2 * min_words // 3
    bits = textcodes.mix(line_dedup.Lines(pa.array([text])).hashes()).tolist()
    bound, count, steps = [], 0, 0
    for h, w in zip(bits, words):
        chosen = h % line_dedup.STEP < w
        count, steps = (0, 0) if chosen else (count, steps)
        bound.append(chosen or count // span > steps)
        steps = count // span
        count += w
    out = {(tuple([line]), i) for i, line in enumerate(lines) if words[i] >= min_words}
    for i in range(len(lines)):
        if bound[i]:
            for j in range(i + 1, len(lines)):
                if bound[j] and (bits[j] >> 32) % 2 == (bits[i] >> 32) % 2 and sum(words[i : j + 1]) >= span:
                    out.add((tuple(lines[i : j + 1]), i))
                    break
    return out


@pytest.mark.parametrize("min_words", [6, 25])
def test_chunks_equal_plain_python(min_words):
    r = random.Random(min_words)
    texts = ["\n".join(say(r, r.choice([1, 1, 2, 4, 9, 30]), "ab") for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts += ["", None, "x\n" * 300, say(r, 400), "a b.\n" * 90]
    x = line_dedup.Lines(pa.array(texts))
    key, at, n = line_dedup.chunks(x, min_words)
    text = np.searchsorted(x.first, at, "right") - 1
    names = {}
    for i, t in enumerate(texts):
        here = np.flatnonzero(text == i)
        got = {(tuple(x.line(k) for k in range(at[j], at[j] + n[j])), int(at[j] - x.first[i])) for j in here}
        assert got == plain_chunks(t or "", min_words)
        for j in here:
            names.setdefault(int(key[j]), set()).add(tuple(x.line(k) for k in range(at[j], at[j] + n[j])))
    assert all(len(v) == 1 for v in names.values())
    assert len(names) == len(set().union(*names.values()))


def test_only_lines_that_stand_before_go(spark):
    """Random texts over few lines: what goes stands, in runs of 25 words, at an earlier place; the rest is kept in order."""
    r = random.Random(4)
    pool = [say(r, r.randint(2, 12)) for _ in range(40)]
    parts = [[r.choice(pool) for _ in range(r.randint(1, 9))] for _ in range(30)]
    texts = ["\n".join(line for _ in range(r.randint(1, 5)) for line in r.choice(parts)) for _ in range(120)]
    got = {x["doc_id"]: x for x in line_dedup.remove_repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    before, removed = [], 0
    for i, t in enumerate(texts):
        lines, words = lines_of(t)
        stands = [False] * len(lines)
        for a in range(len(lines)):
            for z in range(a + 1, len(lines) + 1):
                if sum(words[a:z]) < 25:
                    continue
                run = lines[a:z]
                if not any(d[k : k + len(run)] == run for d in before for k in range(len(d) - len(run) + 1)) and not any(lines[k : k + len(run)] == run for k in range(a)):
                    break
                stands[a:z] = [True] * (z - a)
        kept, reached = lines_of(got[i]["text"])[0], {0}
        for line, may_go in zip(lines, stands):
            reached = {k + 1 for k in reached if k < len(kept) and kept[k] == line} | (reached if may_go else set())
        assert len(kept) in reached and got[i]["n_removed"] == len(lines) - len(kept)
        removed += len(lines) - len(kept)
        before.append(lines)
    assert removed > 500


def test_recall_of_planted_passages(spark):
    """Passages of 2 to 10 lines of 13 words between texts of their own: all of three lines or more are found, and half of two."""
    r = random.Random(5)
    rows, passages = [], []
    for i in range(360):
        passages.append(". ".join(say(r, 13) for _ in range(2 + i % 9)) + ".")
        for copy in range(3):
            rows.append((3 * i + copy, f"{say(r, r.randint(3, 30))}. {passages[-1]} {say(r, r.randint(3, 30))}."))
    got = {x["doc_id"]: x["text"] for x in line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[3 * i] == rows[3 * i][1] for i in range(360))
    found = [all(p not in got[3 * i + c] for c in (1, 2)) for i, p in enumerate(passages)]
    share = {n: np.mean([f for i, f in enumerate(found) if 2 + i % 9 == n]) for n in range(2, 11)}
    assert all(share[n] == 1 for n in range(3, 11)) and 0.2 < share[2] < 0.8


def test_a_passage_whose_parts_stand_first_in_shorter_texts(spark):
    """Each three lines of a passage stand before it in another text; the passage in later texts is found by its other earlier places."""
    r = random.Random(6)
    rows = []
    for case in range(40):
        p = [say(r, 12) + "." for _ in range(4)]
        at = 100 * case
        rows += [(at + k, f"{say(r, 9)}. {' '.join(p[k : k + 2])} {say(r, 9)}.") for k in range(3)]
        rows += [(at + k, f"{say(r, 9)}. {' '.join(p)} {say(r, 9)}.") for k in (10, 11, 12, 13)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    gone = sum(got[100 * case + 13] != text[100 * case + 13] for case in range(40))
    assert gone >= 36
    assert all(got[100 * case + k] == text[100 * case + k] for case in range(40) for k in range(3))
