"""DuckDB SQL twins of the Column functions, used only for verification.

The driver runs each registered Spark query and the matching SQL here on
the same parquet tables and compares rows, schema and values. The patterns
are written out here from the rules, in RE2, and import nothing of the
engine.
"""

from __future__ import annotations

import unicodedata

# What str.strip() takes off, as code points.
SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
WS_SQL = "(" + "||".join(f"chr({c})" for c in SPACES) + ")"
_IN = "".join(rf"\x{{{c:X}}}" for c in SPACES)
SPACE, WORD = f"[{_IN}]", f"[^{_IN}]"
MARKER = rf"[Aa]nswer{SPACE}*[-:]"
FLOAT = r"^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$"
FRACTION = r"^([-+]?)(?:([0-9]+)/([0-9]+)|\\(?:d|t)?frac[{]([0-9]+)[}][{]([0-9]+)[}])$"
DECIMAL = r"^([-+]?)([0-9]*)[.]?([0-9]*)$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def extract(t: str) -> str:
    raw = f"regexp_extract({t}, {q(MARKER + SPACE + '*(.+?)(?:' + chr(92) + 'n|$)')}, 1)"
    return f"(CASE WHEN {raw} <> '' THEN {strip(raw)} END)"


def has_answer_line(t: str) -> str:
    return f"regexp_matches({t}, {q(MARKER + SPACE + '*' + WORD)})"


def norm_letter(s: str) -> str:
    edge = r"[^\pL\pN_]"
    return f"nullif(regexp_extract(upper({s}), {q(f'(?:^|{edge})([A-E])(?:{edge}|$)')}, 1), '')"


def norm_math(s: str) -> str:
    t = f"rtrim({strip(s)}, '.')"
    t = f"regexp_replace({t}, {q(r'[\\]boxed[{]([^{}]*)[}]')}, '\\1', 'g')"
    t = f"replace(replace({t}, '$', ''), ',', '')"
    return strip(t)


def _digits() -> tuple[str, str]:
    other = [c for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(map(chr, other)), "".join(str(unicodedata.digit(chr(c))) for c in other)


def py_float(s: str) -> str:
    other, plain = _digits()
    # twice: neighbouring underscores share a digit
    n = f"regexp_replace(regexp_replace(translate({s}, {q(other)}, {q(plain)}), '([0-9])_([0-9])', '\\1\\2', 'g'), '([0-9])_([0-9])', '\\1\\2', 'g')"
    word = f"ltrim(lower({s}), '+-')"
    return (
        f"(CASE WHEN regexp_matches({n}, {q(FLOAT)}) THEN TRY_CAST({n} AS DOUBLE) "
        f"WHEN length({s}) - length({word}) > 1 THEN NULL WHEN {word} = 'nan' THEN 'nan'::DOUBLE "
        f"WHEN {word} IN ('inf', 'infinity') THEN CASE WHEN {s}[1] = '-' THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END END)"
    )


def g10(x: str) -> str:
    return f"format('{{:.10g}}', {x})"


def vote_key(p: str, task: str) -> str:
    nm = norm_math(p)
    return (
        f"(CASE WHEN {p} IS NULL THEN NULL WHEN {task} = 'arc' THEN {norm_letter(p)} "
        f"WHEN {task} IN ('gsm8k','math') THEN coalesce({g10(py_float(nm))}, {nm}) "
        f"ELSE lower({strip(p)}) END)"
    )


def gold_after_hashes(g: str) -> str:
    return f"(CASE WHEN contains({g}, '####') THEN {strip(f'split_part({g}, {q(chr(35)*4)}, -1)')} ELSE {g} END)"


def gold_gsm8k(a: str) -> str:
    pattern = r"-?\p{Nd}+(?:[.]\p{Nd}+)?"
    numbers = f"regexp_extract_all({a}, {q(pattern)})"
    return (
        f"(CASE WHEN contains({a}, '####') THEN {strip(f'split_part({a}, {q(chr(35)*4)}, -1)')} "
        f"WHEN len({numbers}) > 0 THEN {numbers}[-1] ELSE {strip(a)} END)"
    )


def _ratio(s: str) -> tuple[str, str]:
    """Numerator (with sign) and denominator as HUGEINT, NULL where there is none."""
    f, d = (lambda i: f"regexp_extract({s}, {q(FRACTION)}, {i})"), (lambda i: f"regexp_extract({s}, {q(DECIMAL)}, {i})")
    fraction = f"regexp_matches({s}, {q(FRACTION)})"
    decimal = f"(regexp_matches({s}, {q(DECIMAL)}) AND length({d(2)}) + length({d(3)}) > 0)"
    tail = f"rtrim({d(3)}, '0')"
    sign = f"CASE WHEN {s}[1] = '-' THEN -1 ELSE 1 END"
    num = f"CASE WHEN {fraction} THEN TRY_CAST({f(2)} || {f(4)} AS HUGEINT) WHEN {decimal} THEN TRY_CAST('0' || {d(2)} || {tail} AS HUGEINT) END * ({sign})"
    den = f"CASE WHEN {fraction} THEN TRY_CAST({f(3)} || {f(5)} AS HUGEINT) WHEN {decimal} THEN TRY_CAST('1' || repeat('0', length({tail})) AS HUGEINT) END"
    return f"({num})", f"({den})"


def rational_equal(a: str, b: str) -> str:
    """Cross products; the fixture's numbers stay within HUGEINT."""
    (na, da), (nb, db) = _ratio(a), _ratio(b)
    return f"coalesce({da} > 0 AND {db} > 0 AND {na} * {db} = {nb} * {da}, false)"


def math_equal(p: str, g: str) -> str:
    np_, ng = norm_math(p), norm_math(g)
    return f"(coalesce({np_} = {ng}, false) OR {rational_equal(np_, ng)})"


def float_equal(a: str, b: str) -> str:
    return f"({a} = {b} AND NOT isnan({a}))"


def is_correct(p: str, g: str, task: str) -> str:
    gn = gold_after_hashes(g)
    pf, gf = py_float(norm_math(p)), py_float(norm_math(gn))
    gsm = f"(CASE WHEN {pf} IS NOT NULL AND {gf} IS NOT NULL THEN {float_equal(pf, gf)} ELSE {math_equal(p, gn)} END)"
    res = (
        f"(CASE WHEN {task} = 'arc' THEN {norm_letter(p)} IS NOT DISTINCT FROM {norm_letter(g)} "
        f"WHEN {task} = 'gsm8k' THEN {gsm} WHEN {task} = 'math' THEN {math_equal(p, gn)} "
        f"ELSE lower({strip(p)}) = lower({strip(g)}) END)"
    )
    return f"(CASE WHEN {p} IS NULL THEN false ELSE coalesce({res}, false) END)"


def word_count(t: str) -> str:
    return f"len(regexp_extract_all({t}, {q(WORD + '+')}))"


def dedupe_key(question: str, trace: str) -> str:
    return f"sha1(lower({strip(question)}) || chr(0) || substring({strip(trace)}, 1, 200))"


# Fixture: the same derivation as sources/fixture.py, in DuckDB SQL.
DOCS_SQL = """
SELECT doc_id, text, lang, source, text AS question, task,
  CASE task WHEN 'generic' THEN 'Text ' || (doc_id % 9)
            WHEN 'arc' THEN CASE WHEN doc_id % 30 = 0 THEN '?' ELSE chr(CAST(65 + doc_id % 4 AS INTEGER)) END
            WHEN 'gsm8k' THEN CAST(3 + doc_id % 97 AS VARCHAR)
            ELSE CASE WHEN doc_id % 9 = 2 THEN '0.12345678901' || (1 + doc_id % 7) ELSE (1 + doc_id % 7) || '/' || (2 + doc_id % 5) END END AS g
FROM (SELECT *, CASE WHEN doc_id % 20 = 19 THEN 'generic' WHEN doc_id % 3 = 0 THEN 'arc' WHEN doc_id % 3 = 1 THEN 'gsm8k' ELSE 'math' END AS task
      FROM documents)
"""


def traces_sql(k: int = 8) -> str:
    return f"""
SELECT doc_id AS id, CAST(k AS INTEGER) AS pos, task, question, gold,
  CASE WHEN (doc_id + k) % 16 = 0 THEN text
       WHEN k = 7 THEN text || chr(10) || '</think>' || chr(10) || 'Answer: ' || ans || chr(10) || 'Answer: 0'
       WHEN k = 6 THEN 'Answer: ' || ans || chr(10) || text
       ELSE '<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || 'Answer: ' || ans END AS trace,
  lang, source
FROM (
  SELECT *, CASE task WHEN 'gsm8k' THEN 'so #### ' || g ELSE g END AS gold,
    CASE WHEN (doc_id * 31 + k * 17) % 20 < 11 THEN
      CASE task WHEN 'arc' THEN CASE k % 3 WHEN 0 THEN g WHEN 1 THEN '(' || lower(g) || ')' ELSE g || ' is best' END
                WHEN 'gsm8k' THEN CASE k % 4 WHEN 0 THEN CASE WHEN doc_id % 11 = 0 AND length(g) = 2 THEN g[1] || '_' || g[2] ELSE g END
                                             WHEN 1 THEN g || '.0' WHEN 2 THEN '$' || g ELSE g || '.' END
                WHEN 'generic' THEN CASE k % 2 WHEN 0 THEN upper(g) ELSE ' ' || g END
                ELSE CASE k % 2 WHEN 0 THEN CASE WHEN doc_id % 9 = 2 THEN g || '0' ELSE g END ELSE chr(92) || 'boxed{{' || g || '}}' END END
    ELSE CASE task WHEN 'arc' THEN chr(CAST(65 + (doc_id + k + 1) % 5 AS INTEGER)) ELSE CAST((doc_id + k) % 3 AS VARCHAR) END END AS ans
  FROM (SELECT *, unnest(range(0, {k})) AS k FROM ({DOCS_SQL}) d)) x
"""


# Expression answers: the same texts as the fixture's, and their values by
# arithmetic on the numbers they are made of; nothing here reads a formula.
def expressions_sql(k: int = 8) -> str:
    frac = r"'\frac{' || {} || '}{' || {} || '}'"
    f = lambda x, y: frac.replace("{}", "{0}", 1).replace("{}", "{1}", 1).replace("{0}", str(x)).replace("{1}", str(y))
    gold = {
        0: "'(x+' || a || ')(x-' || b || ')'", 1: f("a", "b") + " || '+' || " + f("1", "c"), 2: r"'\sqrt{' || a * a * b || '}'",
        3: f("a", r"('\sqrt{' || b || '}')"), 4: r"'(' || a || '+\sqrt{' || b || '})^2'", 5: r"'\{' || a || ', ' || b || ', ' || (a + b) || '\}'",
        6: "'(' || a || ', ' || " + f("b", "2") + " || ')'", 7: "'[' || a || ', ' || (a + b) || ')'",
        8: r"'\begin{pmatrix}' || a || ' & ' || b || '\ ' || c || ' & 1\end{pmatrix}'", 9: f(r"(a || '\pi')", "b"), 10: "CAST(a AS VARCHAR)",
        11: r"'x^{' || a || '}\cdot x^{' || b || '}'",
    }
    answer = {
        0: "'x^2+(' || (a - b + one) || ')x-' || a * b", 1: r"'\d' || substring(" + f("(a * c + b + one)", "b * c") + ", 2)", 2: r"(a + one) || '\sqrt{' || b || '}'",
        3: f(r"(a || '\sqrt{' || b || '}')", "(b + one)"), 4: r"(a * a + b + one) || '+' || 2 * a || '\sqrt ' || b",
        5: r"CASE WHEN same THEN '\left\{' ELSE '(' END || (a + b) || ',' || b || ',' || a || CASE WHEN same THEN '\right\}' ELSE ')' END",
        6: "CASE WHEN same THEN '(' || a || ',' || b || '/2)' ELSE '(' || b || '/2,' || a || ')' END",
        7: r"'\left[' || a || ',' || " + f("2 * (a + b)", "2") + r" || CASE WHEN same THEN '\right)' ELSE '\right]' END",
        8: r"'\begin{bmatrix}' || a || '&' || CASE WHEN same THEN b ELSE c END || '\\' || CASE WHEN same THEN 2 * c ELSE 2 * b END || '/2&1\end{bmatrix}'",
        9: r"CASE WHEN same THEN a || '/' || b || '\cdot\pi' ELSE " + f(r"(b || '\pi')", "a") + " END", 10: r"a || '\text{ units}'", 11: "'x^{' || CASE WHEN same THEN a + b ELSE a * b END || '}'",
    }
    ratio = lambda x, y: f"({x}) // gcd({x}, {y}) || '/' || ({y}) // gcd({x}, {y})"
    value = {
        0: "(a - b + one) || ',' || a * b", 1: ratio("a * c + b + one", "b * c"), 2: "CAST((a + one) * (a + one) * b AS VARCHAR)",
        3: ratio("a * a * b", "(b + one) * (b + one)"), 4: "CASE WHEN b = 4 THEN (a * a + 4 + one + 4 * a) || ',0' ELSE (a * a + b + one) || ',' || 4 * a * a * b END",
        5: "CASE WHEN same THEN 'set' || CAST(list_sort(list_distinct([a, b, a + b])) AS VARCHAR) ELSE 'tuple' || CAST([a + b, b, a] AS VARCHAR) END",
        6: "CASE WHEN same THEN 2 * a || ',' || b ELSE b || ',' || 2 * a END", 7: "a || ',' || (a + b) || same",
        8: "a || ',' || CASE WHEN same THEN b || ',' || c ELSE c || ',' || b END", 9: f"CASE WHEN same THEN {ratio('a', 'b')} ELSE {ratio('b', 'a')} END",
        10: "NULL", 11: "CAST(CASE WHEN same THEN a + b ELSE a * b END AS VARCHAR)",
    }
    also = {6: "2 * a = b", 8: "b = c", 9: "a = b", 11: "a + b = a * b"}  # wrong forms that happen to be right
    pick = lambda d: "CASE form " + " ".join(f"WHEN {n} THEN {x}" for n, x in d.items()) + " END"
    truth = "CASE WHEN form = 10 THEN NULL WHEN same THEN true " + " ".join(f"WHEN form = {n} THEN {x}" for n, x in also.items()) + " ELSE false END"
    return f"""
SELECT id, pos, form, gold, {extract("text || chr(10) || 'Answer: ' || said")} AS answer, equal, value
FROM (
  SELECT doc_id AS id, CAST(k AS INTEGER) AS pos, CAST(form AS INTEGER) AS form, text, {pick(gold)} AS gold, {pick(answer)} AS said, {truth} AS equal, {pick(value)} AS value
  FROM (
    SELECT *, CASE WHEN same THEN 0 ELSE 1 END AS one FROM (
      SELECT doc_id, text, k, (doc_id + k) % 12 AS form, (doc_id * 31 + k * 17) % 20 < 11 AS same, 1 + doc_id % 7 AS a, 2 + doc_id % 5 AS b, 1 + (doc_id // 7) % 9 AS c
      FROM (SELECT doc_id, text, unnest(range(0, {k})) AS k FROM documents)))
)
"""
