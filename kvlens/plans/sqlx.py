"""DuckDB SQL fragments for the oracle side of each query.

An independent statement of each operator in SQL, using the same fixed
pattern values.  RE2 differs from Java regex: no ``(?U)`` / ``(?d)`` flags
(``.`` already stops at a newline), ASCII classes.
"""

from __future__ import annotations

from ..functions import patterns as P


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def m(col: str, pattern: str) -> str:
    """``re.match``."""
    return f"regexp_matches({col}, {q('^(?:' + pattern + ')')})"


def has(col: str, pattern: str) -> str:
    """``re.search``."""
    return f"regexp_matches({col}, {q(pattern)})"


def sub(col: str, pattern: str, repl: str) -> str:
    """``re.sub`` (all matches); ``repl`` uses ``\\1``."""
    return f"regexp_replace({col}, {q(pattern)}, {q(repl)}, 'g')"


def first_line(col: str) -> str:
    return f"split_part({col}, chr(10), 1)"


def lit_replace(col: str, pairs) -> str:
    for k, v in pairs:
        col = f"replace({col}, {q(k)}, {q(v)})"
    return col


def kw(col: str, words, lower: bool) -> str:
    import re
    text = f"lower({col})" if lower else col
    alt = "|".join(w if ".*" in w else re.escape(w).replace("\\ ", " ") for w in words)
    return has(first_line(text), alt)


# --- classifiers -------------------------------------------------------------

def max_operator(c):
    return kw(c, P.MAX_WORDS, True)


def min_operator(c):
    return kw(c, P.MIN_WORDS, True)


def count_operator(c):
    return kw(c, P.COUNT_WORDS, True)


def sum_operator(c):
    return kw(c, P.SUM_WORDS, True)


def difference_operator(c):
    return kw(c, P.DIFF_WORDS, True)


def average_operator(c):
    return kw(c, P.AVG_WORDS, True)


def comparison_operator(c):
    return kw(c, P.COMPARE_WORDS, True)


def before_related(c):
    return kw(c, P.BEFORE_WORDS, False)


def after_related(c):
    return kw(c, P.AFTER_WORDS, False)


def duration_related(c):
    line = first_line(c)
    return (f"({kw(c, P.DURATION_WORDS, False)} OR (contains({line}, 'last') AND NOT contains({line}, ' last ')) "
            f"OR {has(line, 'how many ((total|active|more|calendar) )?(year|day|season|month|decade|week|hour|century)')})")


def explicit(c):
    return m(c, "|".join(P.EXPLICIT_PATTERNS))


def implicit(c):
    return f"(NOT {explicit(c)})"


def ordinal(c):
    return (f"(({m(c, P.ORDINAL_DIGIT)} AND NOT ({m(c, P.ORDINAL_DATE)} OR {m(c, P.ORDINAL_MONTH)})) "
            f"OR {kw(c, P.ORDINAL_WORDS, False)} OR {m(c, P.ORDINAL_RANK)})")


def yes_no(qc, ac):
    qc, ac = f"lower({qc})", f"lower({ac})"
    shapes = "|".join(f"(in {s} )?{P.YES_NO_VERBS}" for s in P.YES_NO_SHAPES)
    answers = ", ".join(q(x) for x in P.YES_NO_ANSWERS)
    return (f"({m(qc, P.YES_NO_WORDING)} OR ({m(qc, shapes)} AND (NOT {m(qc, P.YES_NO_CHOICE)} "
            f"OR {m(qc, P.YES_NO_OR_NOT)})) OR {ac} IN ({answers}))")


def temporal_answer(qc, ac):
    return (f"({m(ac, '|'.join(P.TEMPORAL_ANSWER_PATTERNS))} OR {m(qc, P.TA_QUESTION_YEAR)} "
            f"OR ({m(ac, P.TA_YEAR)} AND {m(qc, P.TA_QUESTION_WHEN)}) OR {m(qc, P.TA_QUESTION_SOON)})")


def count_answer(qc, ac):
    return f"({m(qc, P.COUNT_HOW_MANY)} OR ({m(qc, P.COUNT_NUMBER_OF)} AND {m(ac, P.ANY_DIGIT)}))"


def age_answer(qc, ac):
    return f"({m(qc, P.AGE_QUESTION)} OR {m(qc, P.AGE_SUFFIX)})"


def money_answer(qc, ac):
    return (f"({m(ac, P.MONEY_SYMBOL)} OR ({m(ac, P.MONEY_MAGNITUDE)} AND {m(qc, P.MONEY_TOPIC)}) "
            f"OR {m(qc, P.MONEY_QUESTION)})")


def percentage_answer(qc, ac):
    return f"({m(qc, P.PERCENT_QUESTION)} OR {m(ac, P.PERCENT_ANSWER)})"


def rank_answer(qc, ac):
    return (f"(({m(qc, P.RANK_WHERE)} AND {m(qc, P.RANK_WORD)}) OR {m(qc, P.RANK_WHAT)} "
            f"OR {m(ac, P.RANK_SUFFIX)} OR {m(ac, P.RANK_PLACE)})")


def answer_type(qcol, acol):
    qc = f"lower({qcol})"
    ac = lit_replace(f"lower({acol})", P.NUMBER_WORDS_12)
    return f"""(CASE
      WHEN {yes_no(qc, ac)} THEN 'YES/NO'
      WHEN {temporal_answer(qc, ac)} THEN 'TEMPORAL'
      WHEN {count_answer(qc, ac)} THEN 'COUNT'
      WHEN {age_answer(qc, ac)} THEN 'AGE'
      WHEN {money_answer(qc, ac)} THEN 'MONEY'
      WHEN {percentage_answer(qc, ac)} THEN 'PERCENTAGE'
      WHEN {rank_answer(qc, ac)} THEN 'ORDINAL'
      WHEN {m(qc, P.PLACE_QUESTION)} THEN 'PLACE'
      WHEN {m(qc, P.RANK_WHERE)} AND NOT {m(qc, P.RANK_WORD)} THEN 'PLACE'
      WHEN {m(qc, P.PERSON_QUESTION)} THEN 'PERSON'
      WHEN {m(qc, P.ORGANIZATION_QUESTION)} THEN 'ORGANIZATION'
      WHEN {m(qc, P.PRODUCT_QUESTION)} THEN 'PRODUCT'
      ELSE 'UNKNOWN' END)"""


FLAGS = {
    "explicit": explicit,
    "implicit": implicit,
    "before_related": before_related,
    "after_related": after_related,
    "duration_related": duration_related,
    "max_operator": max_operator,
    "min_operator": min_operator,
    "count_operator": count_operator,
    "sum_operator": sum_operator,
    "difference_operator": difference_operator,
    "average_operator": average_operator,
    "comparison_operator": comparison_operator,
    "ordinal": ordinal,
}


def is_temporal(qc, ac):
    nouns, hours = (f"(({')|('.join(w)}))" for w in (P.IT_PROPER_NOUNS, P.IT_TIMES_OF_DAY))
    question = "|".join([
        P.IT_FINANCIAL,
        r".*(before|after|at|of|since|as early as|through|until|this|for)( the)? " + hours + r"( |,|\?).*",
        r".*\d{4} " + nouns + ".*",
        "(" + ")|(".join(P.IT_KEYWORD_TIME) + ")",
        P.IT_ALBUM, P.TIME_PATTERN, P.IT_MONTHS, P.IT_DAYS, P.TIME_KEYWORD0, P.TIME_KEYWORD1, P.IT_YEAR0, P.IT_YEAR1, P.IT_YEAR2,
        *(getattr(P, f"IT_DATE{i}") for i in range(19) if i != 14),
    ])
    answer = "|".join([
        r".*\d{4} " + nouns + ".*", P.TIME_PATTERN, P.IT_MONTHS,
        *(getattr(P, f"IT_DATE{i}") for i in (0, 2, 4, 5, 6, 8, 10, 11, 12, 18)),
    ])
    return (f"({m(qc, question)} OR {kw(qc, P.IT_KEYWORDS, False)} OR {m(ac, answer)} "
            f"OR ({m(qc, '|'.join(P.IT_ANSWER_QUESTION))} AND {m(ac, P.IT_ANSWER_YEAR)}))")


def text_preprocess(c):
    return lit_replace(lit_replace(f"lower({c})", P.NUMBER_WORDS_12), P.ITALIAN_MONTHS)


# --- text helpers and metrics ---------------------------------------------------

WS = r"[\s\p{Z}\x{85}\x{0b}]+"
WORD = r"\pL\pN_"


def tokens(c):
    return f"list_filter(string_split_regex({c}, {q(WS)}), lambda w: w <> '')"


def lower_tokens(c):
    return tokens(f"lower({c})")


def number_name_to_int(c):
    names = ", ".join(q(k) for k, _ in P.NUMBER_NAMES)
    values = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in P.NUMBER_NAMES)
    words = tokens(c)
    return (f"(CASE WHEN len(list_filter({words}, lambda w: NOT (w IN ({names}) OR w = 'and'))) = 0 "
            f"THEN CAST(coalesce(list_sum(list_transform({words}, lambda w: CASE w {values} ELSE 0 END)), 0) AS STRING) "
            f"ELSE {c} END)")


def time_canonical(c, strict=False):
    rx = P.TIME_RE.replace("(:|.)", "(:)") if strict else P.TIME_RE
    h = f"regexp_extract({c}, {q(rx)}, 1)"
    mi = f"regexp_extract({c}, {q(rx)}, 3)"
    ap = f"regexp_extract({c}, {q(rx)}, 4)"
    h24 = (f"(CASE WHEN {ap} IN ('PM', 'pm') AND {h} <> '12' THEN CAST(CAST({h} AS INT) + 12 AS STRING) "
           f"WHEN {ap} IN ('AM', 'am') AND {h} = '12' THEN '00' ELSE {h} END)")
    return f"(CASE WHEN {has(c, rx)} THEN lpad({h24}, 2, '0') || ':' || {mi} ELSE {c} END)"


def _month_no(expr):
    abbrs = " ".join(f"WHEN {q(a)} THEN '{i + 1:02d}'" for i, a in enumerate(P.MONTH_ABBR))
    return f"(CASE lower(substr({expr}, 1, 3)) {abbrs} END)"


def date_ddmm(c):
    out = c
    for pat, dg, mg in [(P.DDMM_ABBR_DAY, 2, 1), (P.DDMM_MONTH_DAY, 2, 1),
                        (P.DDMM_DAY_ABBR, 1, 2), (P.DDMM_DAY_MONTH, 1, 2)]:
        rx = "(?i)" + pat
        day = f"regexp_extract({c}, {q(rx)}, {dg})"
        mon = f"regexp_extract({c}, {q(rx)}, {mg})"
        out = f"(CASE WHEN {has(c, rx)} THEN lpad({day}, 2, '0') || '-' || {_month_no(mon)} ELSE {out} END)"
    return out


def drop_word_dots(c):
    return sub(c, f"([{WORD}])\\.", "\\1")


def dates_to_iso(c):
    """Day and month with a zero in front, of which the last two digits stay."""
    moved = sub(c, r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})", r"<\3-0\2-0\1>")
    return sub(moved, r"<(\d{4})-0?(\d{2})-0?(\d{2})>", r"\1-\2-\3")


def digit_runs(c):
    return f"regexp_extract_all({c}, '(\\d+)', 1)"


def squad_normalise(c):
    s = f"translate(lower({c}), {q(P.PUNCTUATION)}, '')"
    art = f"(^|[^{WORD}])(a|an|the)([^{WORD}]|$)"
    s = sub(sub(s, art, "\\1 \\3"), art, "\\1 \\3")
    return f"array_to_string({tokens(s)}, ' ')"


def multiset_overlap(a, b):
    return (f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: "
            f"least(len(list_filter({a}, lambda x: x = t)), len(list_filter({b}, lambda x: x = t))))), 0)")


def squad_exact(g, p):
    return f"CAST({squad_normalise(g)} = {squad_normalise(p)} AS DOUBLE)"


def squad_f1(g, p):
    gt, pt = tokens(squad_normalise(g)), tokens(squad_normalise(p))
    same = multiset_overlap(gt, pt)
    return (f"(CASE WHEN len({gt}) = 0 OR len({pt}) = 0 THEN CAST(len({gt}) = len({pt}) AS DOUBLE) "
            f"WHEN {same} = 0 THEN 0.0 "
            f"ELSE 2.0 * ({same} / len({pt})) * ({same} / len({gt})) / (({same} / len({pt})) + ({same} / len({gt}))) END)")


def token_exact(r, p):
    return f"({lower_tokens(r)} = {lower_tokens(p)})"


def token_set_f1(r, p):
    rs, ps = f"list_distinct({lower_tokens(r)})", f"list_distinct({lower_tokens(p)})"
    inter = f"len(list_intersect({rs}, {ps}))"
    prec = f"(CASE WHEN len({ps}) = 0 THEN 0.0 ELSE {inter} / len({ps}) END)"
    rec = f"(CASE WHEN len({rs}) = 0 THEN 0.0 ELSE {inter} / len({rs}) END)"
    return f"(CASE WHEN {prec} + {rec} = 0 THEN 0.0 ELSE 2 * {prec} * {rec} / ({prec} + {rec}) END)"


# --- annotation normalisers ---------------------------------------------------------

def _answer_prefix(c):
    s = f"lower({c})"
    s = sub(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    s = sub(s, '["~#%>+]', "")
    s = lit_replace(s, [(t, "") for t in P.CURRENCY_TOKENS])
    s = sub(s, r"\.$", "")
    s = sub(s, r"^\.", "")
    return lit_replace(s, P.NUMBER_WORDS_10)


def normalise_gold(c):
    s = _answer_prefix(c)
    s = sub(s, P.TRAILING_PAREN, "")
    s = sub(s, P.ORDINAL_SUFFIX, "\\1")
    s = sub(s, P.GOLD_UNITS, "\\2")
    return sub(s, P.GOLD_PREFIX, "\\2")


def normalise_answer(c):
    s = _answer_prefix(c)
    s = sub(s, P.ORDINAL_SUFFIX, "\\1")
    return sub(s, P.ANSWER_UNITS, "\\2")


def align_to_gold(a, g):
    conds = [f"contains({a}, ' ' || {g} || ' ')", f"contains({a}, ' ' || {g} || ',')",
             f"contains({a}, ' ' || {g} || '. ')"]
    conds += [f"prefix({a}, {g} || {q(w)})" for w in P.ALIGN_PREFIX_SUFFIXES]
    conds += [f"suffix({a}, ' ' || {g})",
              f"({a} <> {g} AND contains({a}, {g}) AND regexp_matches({a}, '^.*\\(.*\\)$') "
              f"AND regexp_extract({a}, '^.*\\((.*)\\)$', 1) = {g})"]
    return f"(CASE WHEN {' OR '.join(conds)} THEN {g} ELSE {a} END)"


def fill(template: str, **slots: str) -> str:
    """Prompt template -> SQL concatenation of literals and slot expressions."""
    import re as _re
    parts, pos = [], 0
    for mm in _re.finditer(r"\{(question|context|json_table)\}", template):
        parts.append(q(template[pos:mm.start()]))
        parts.append(f"({slots[mm.group(1)]})")
        pos = mm.end()
    parts.append(q(template[pos:]))
    return " || ".join(parts)


# --- ROUGE and METEOR (M5-M7) ----------------------------------------------------

def _letters(w: str) -> str:
    return (f"list_reduce(string_split({w}, ''), lambda a, ch: a || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') THEN 'v' "
            f"WHEN ch <> 'y' THEN 'c' WHEN a = '' OR a[-1] = 'v' THEN 'c' ELSE 'v' END, '')")


def stem_ctes(src: str) -> str:
    """CTEs that end in ``stems(word, stem)`` over ``src(word)``: one SELECT a step."""
    from ..functions import stemming as St

    def cut(c, n):
        return f"left({c}, len({c}) - {n})"

    def end(*s):
        return "(" + " OR ".join(f"suffix(w, '{x}')" for x in s) + ")"

    def has_(c, p):
        return f"regexp_matches({c}, '{p}')"

    def m1(c):
        return f"({has_(c, 'vc')} AND NOT {has_(c, 'vc+v+c')})"

    def cvc(w, c):
        return f"(({has_(c, 'cvc$')} AND right({w}, 1) NOT IN ('w', 'x', 'y')) OR {c} = 'vc')"

    def rules(pairs, least):
        return "CASE " + " ".join(f"WHEN suffix(w, '{s}') THEN CASE WHEN {has_(cut('cv', len(s)), least)} THEN {cut('w', len(s))} || '{t}' ELSE w END" for s, t in pairs) + " ELSE w END"

    double = "(len(w) >= 2 AND right(w, 1) = left(right(w, 2), 1) AND suffix(cv, 'c'))"
    ion = f"WHEN suffix(w, 'ion') THEN CASE WHEN {has_(cut('cv', 3), 'vc+v+c')} AND right({cut('w', 3)}, 1) IN ('s', 't') THEN {cut('w', 3)} ELSE w END"
    step4 = "CASE " + " ".join(ion if s == "ion" else f"WHEN suffix(w, '{s}') THEN CASE WHEN {has_(cut('cv', len(s)), 'vc+v+c')} THEN {cut('w', len(s))} ELSE w END" for s in St.STEP4) + " ELSE w END"
    odd = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in St.IRREGULAR.items())
    return f"""
p1 AS (SELECT word, CASE WHEN {end('ies')} AND len(word) = 4 THEN {cut('w', 1)} WHEN {end('sses', 'ies')} THEN {cut('w', 2)} WHEN {end('ss')} THEN w
              WHEN {end('s')} THEN {cut('w', 1)} ELSE w END AS w FROM (SELECT word, word AS w FROM {src})),
p2 AS MATERIALIZED (SELECT *, {_letters('w')} AS cv FROM p1),
p3 AS (SELECT *, CASE WHEN {end('ied', 'eed')} THEN 0 WHEN {end('ed')} AND contains({cut('cv', 2)}, 'v') THEN 2 WHEN {end('ing')} AND contains({cut('cv', 3)}, 'v') THEN 3 ELSE 0 END AS gone FROM p2),
p4 AS (SELECT word, cv, gone, CASE WHEN {end('ied')} THEN {cut('w', 3)} || CASE WHEN len(w) = 4 THEN 'ie' ELSE 'i' END WHEN {end('eed')} AND {has_(cut('cv', 3), 'vc')} THEN {cut('w', 1)}
              ELSE left(w, len(w) - gone) END AS w FROM p3),
p5 AS (SELECT word, gone, w, left(cv, len(w)) AS cv FROM p4),
p6 AS (SELECT word, CASE WHEN gone = 0 THEN w WHEN {end('at', 'bl', 'iz')} THEN w || 'e' WHEN {double} AND right(w, 1) NOT IN ('l', 's', 'z') THEN {cut('w', 1)}
              WHEN {m1('cv')} AND {cvc('w', 'cv')} THEN w || 'e' ELSE w END AS w FROM p5),
p7 AS MATERIALIZED (SELECT word, w, {_letters('w')} AS cv FROM p6),
p8 AS (SELECT word, cv, CASE WHEN {end('y')} AND len(w) > 2 AND right({cut('cv', 1)}, 1) = 'c' THEN {cut('w', 1)} || 'i' ELSE w END AS w FROM p7),
p9 AS (SELECT word, CASE WHEN {end('alli')} AND {has_(cut('cv', 4), 'vc')} THEN {cut('w', 2)} ELSE w END AS w, cv FROM p8),
p10 AS (SELECT word, w, left(cv, len(w)) AS cv FROM p9),
p11 AS (SELECT word, CASE WHEN {end('logi')} AND {has_(cut('cv', 3), 'vc')} THEN {cut('w', 1)} ELSE {rules(St.STEP2, 'vc')} END AS w FROM p10),
p12 AS MATERIALIZED (SELECT word, w, {_letters('w')} AS cv FROM p11),
p13 AS (SELECT word, {rules(St.STEP3, 'vc')} AS w FROM p12),
p14 AS MATERIALIZED (SELECT word, w, {_letters('w')} AS cv FROM p13),
p15 AS (SELECT word, cv, {step4} AS w FROM p14),
p16 AS (SELECT word, w, left(cv, len(w)) AS cv FROM p15),
p17 AS (SELECT word, cv, CASE WHEN {end('e')} AND ({has_(cut('cv', 1), 'vc+v+c')} OR ({m1(cut('cv', 1))} AND NOT {cvc(cut('w', 1), cut('cv', 1))})) THEN {cut('w', 1)} ELSE w END AS w FROM p16),
p18 AS (SELECT word, w, left(cv, len(w)) AS cv FROM p17),
stems AS MATERIALIZED (SELECT word, CASE word {odd} ELSE CASE WHEN len(word) <= 2 THEN word WHEN {has_('cv', 'vc+v+c')} AND {double} AND {end('l')} THEN {cut('w', 1)} ELSE w END END AS stem FROM p18)"""


def rouge_meteor_ctes(src: str, actual: str, pred: str) -> str:
    """CTEs that end in ``scored``: every row of ``src`` with rouge1, rougeL and meteor.
    ROUGE-L is the plain dynamic programme, METEOR's stages are windows numbered from the end."""
    lcs = """list_reduce(ra, lambda old, t: list_reduce(list_zip(rp, range(1, len(rp) + 1)),
        lambda new, x: list_append(new, CASE WHEN x[1] = t THEN (CASE WHEN x[2] = 1 THEN 0 ELSE old[x[2] - 1] END) + 1
                                             ELSE greatest(old[x[2]], CASE WHEN x[2] = 1 THEN 0 ELSE new[x[2] - 1] END) END), []::BIGINT[]),
        list_transform(rp, lambda y: 0::BIGINT))[-1]"""

    def last_first(part: str) -> str:
        return f"row_number() OVER (PARTITION BY pair, side, {part} ORDER BY i DESC)"

    return f"""
pairs AS MATERIALIZED (SELECT row_number() OVER () AS pair, a, p FROM (SELECT DISTINCT coalesce({actual}, 'nan') AS a, coalesce({pred}, 'nan') AS p FROM {src})),
toks AS MATERIALIZED (SELECT pair, regexp_extract_all(lower(a), '[a-z0-9]+') AS ra, regexp_extract_all(lower(p), '[a-z0-9]+') AS rp, {lower_tokens('a')} AS ma, {lower_tokens('p')} AS mp FROM pairs),
vocabulary AS MATERIALIZED (SELECT DISTINCT unnest(list_concat(list_concat(ra, rp), list_concat(ma, mp))) AS word FROM toks),
{stem_ctes('vocabulary')},
rouge_words AS MATERIALIZED (
  SELECT pair, side, i, CASE WHEN len(word) > 3 THEN stem ELSE word END AS stem
  FROM (SELECT pair, 'a' AS side, unnest(ra) AS word, unnest(range(len(ra))) AS i FROM toks UNION ALL SELECT pair, 'p', unnest(rp), unnest(range(len(rp))) FROM toks) JOIN stems USING (word)),
shared AS (
  SELECT pair, sum(least(x, y)) AS overlap FROM (SELECT pair, stem, count(*) FILTER (side = 'a') AS x, count(*) FILTER (side = 'p') AS y FROM rouge_words GROUP BY pair, stem) GROUP BY pair),
stemmed AS MATERIALIZED (
  SELECT pair, coalesce(list(stem ORDER BY i) FILTER (side = 'a'), []) AS ra, coalesce(list(stem ORDER BY i) FILTER (side = 'p'), []) AS rp FROM rouge_words GROUP BY pair),
rouge AS (
  SELECT pair, len(ra) AS na, len(rp) AS np, overlap, CASE WHEN len(ra) = 0 OR len(rp) = 0 THEN 0 ELSE {lcs} END AS lcs FROM stemmed JOIN shared USING (pair)),
meteor_words AS MATERIALIZED (
  SELECT pair, side, i, word, stem
  FROM (SELECT pair, 'a' AS side, unnest(ma) AS word, unnest(range(len(ma))) AS i FROM toks UNION ALL SELECT pair, 'p', unnest(mp), unnest(range(len(mp))) FROM toks) JOIN stems USING (word)),
exact_no AS MATERIALIZED (SELECT *, {last_first('word')} AS k FROM meteor_words),
exact_at AS MATERIALIZED (SELECT p.pair, p.i AS h, a.i AS r FROM exact_no p JOIN exact_no a ON p.pair = a.pair AND p.word = a.word AND p.k = a.k AND p.side = 'p' AND a.side = 'a'),
stem_no AS MATERIALIZED (
  SELECT *, {last_first('stem')} AS k FROM meteor_words w
  WHERE NOT EXISTS (SELECT 1 FROM exact_at x WHERE x.pair = w.pair AND CASE WHEN w.side = 'p' THEN x.h ELSE x.r END = w.i)),
matched AS MATERIALIZED (
  SELECT * FROM exact_at
  UNION ALL SELECT p.pair, p.i, a.i FROM stem_no p JOIN stem_no a ON p.pair = a.pair AND p.stem = a.stem AND p.k = a.k AND p.side = 'p' AND a.side = 'a'),
aligned AS (
  SELECT pair, count(*) AS m, sum(CASE WHEN h = h0 + 1 AND r = r0 + 1 THEN 0 ELSE 1 END) AS chunks
  FROM (SELECT *, lag(h) OVER (PARTITION BY pair ORDER BY h) AS h0, lag(r) OVER (PARTITION BY pair ORDER BY h) AS r0 FROM matched) GROUP BY pair),
pair_scores AS MATERIALIZED (
  SELECT pairs.a, pairs.p,
    CASE WHEN coalesce(overlap, 0) = 0 THEN 0.0 ELSE 2 * (overlap / np) * (overlap / na) / (overlap / np + overlap / na) END AS rouge1,
    CASE WHEN coalesce(lcs, 0) = 0 THEN 0.0 ELSE 2 * (lcs / np) * (lcs / na) / (lcs / np + lcs / na) END AS "rougeL",
    CASE WHEN coalesce(m, 0) = 0 THEN 0.0 ELSE (1 - 0.5 * pow(chunks / m, 3.0)) * (m / len(mp)) * (m / len(ma)) / (0.9::DOUBLE * (m / len(mp)) + (1 - 0.9::DOUBLE) * (m / len(ma))) END AS meteor
  FROM pairs JOIN toks USING (pair) LEFT JOIN rouge USING (pair) LEFT JOIN aligned USING (pair)),
scored AS (SELECT s.*, rouge1, "rougeL", meteor FROM {src} s JOIN pair_scores q ON q.a = coalesce(s.{actual}, 'nan') AND q.p = coalesce(s.{pred}, 'nan'))"""
