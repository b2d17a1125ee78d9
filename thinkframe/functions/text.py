"""Column functions that carry the string and number rules of the pipeline.

Every function here maps Columns to a Column and compiles to built-in
Spark expressions (no Python UDF), so it stays inside whole-stage codegen
and runs next to the scan. The rules follow Python's ``str`` / ``float`` /
``re`` semantics, which is what the answer extraction, normalisation and
equality rules were written against:

* whitespace is Python's ``str.isspace`` set, not Java's or SQL's;
* ``.`` in the answer regex stops only at ``\\n`` (Java needs ``(?d)``);
* word boundaries use Unicode letters/digits;
* ``float()`` parsing is gated by a regex so Spark does not accept what
  Python refuses (``1d``, ``0x1p3``);
* ``%.10g`` formatting is rebuilt from ``%.9e`` text because Java's ``%g``
  keeps trailing zeros.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for equal results)
# --------------------------------------------------------------------------
# Python's str.isspace() set, in code-point order.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex character class body, valid in Java and RE2.
WS_CLASS_BODY = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = "[" + WS_CLASS_BODY + "]"
NON_WS = "[^" + WS_CLASS_BODY + "]"

# Final-answer marker: "Answer:" / "answer -" followed by the rest of the line.
ANSWER_RE = r"(?d)[Aa]nswer" + WS + r"*[:\-]" + WS + r"*(.+?)(?:\n|$)"
# "An answer line is present": marker followed by a non-space character.
ANSWER_PRESENT_RE = r"[Aa]nswer" + WS + r"*[:\-]" + WS + r"*" + NON_WS
# Standalone choice letter A-E (word characters are Unicode letters, digits, _).
LETTER_RE = r"(?:^|[^\pL\pN_])([A-Ea-e])(?:[^\pL\pN_]|$)"
# \boxed{...} without nested braces.
BOXED_RE = r"\\boxed\{([^{}]*)\}"
# Last number in a GSM8K answer field.
NUMBER_RE = r"-?\p{Nd}+(?:\.\p{Nd}+)?"
# Decimal digits beyond ASCII and their values, from the Unicode tables.
OTHER_DIGITS = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}
# Strings Python's float() accepts, once other digits and "_" between digits are gone.
PY_FLOAT_RE = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"

# Chat-template end marker used by response repair and RL gold recovery.
IM_END = "<|im_end|>"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def evaluate_once(df, **exprs):
    """Add columns that are computed exactly once per row.

    A filter on a computed column is normally pushed below the projection
    that defines it, so the expression runs twice (filter, then project) and
    nested rules get inlined into one huge predicate. A one-element
    ``inline`` (a Generate) is a boundary filters do not cross.
    """
    fields = [col(e).alias(n) for n, e in exprs.items()]
    return df.select("*", F.inline(F.array(F.struct(*fields))))


# --------------------------------------------------------------------------
# §2.13 helpers
# --------------------------------------------------------------------------
def pystrip(c) -> Column:
    """Python ``str.strip()``: trim the whole Unicode whitespace set."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def word_count(c) -> Column:
    """``len(s.split())``: number of maximal non-whitespace runs."""
    return F.regexp_count(col(c), F.lit(NON_WS + "+"))


def has_min_words(c, n: int) -> Column:
    """``len(s.split()) >= n`` without counting every word.

    An anchored regex that stops after the n-th word; possessive quantifiers
    (the classes are disjoint) keep it linear in the text it reads.
    """
    if n <= 0:
        return F.lit(True)
    pattern = "^" + WS + "*+(?:" + NON_WS + "++" + WS + "++){" + str(n - 1) + "}" + NON_WS
    return col(c).rlike(pattern)


def _plain_number(s: Column) -> Column:
    """Other decimal digits become ASCII, and single underscores between digits go."""
    ascii_ = F.when(s.rlike("[^\\x00-\\x7F]"), F.translate(s, "".join(OTHER_DIGITS), "".join(OTHER_DIGITS.values()))).otherwise(s)
    return F.regexp_replace(ascii_, "(?<=[0-9])_(?=[0-9])", "")


def py_float(c) -> Column:
    """``float(s)`` for an already stripped string, NULL where Python raises.

    Signed special values (``-nan``, ``+inf``, ``-infinity``) are mapped
    explicitly; Spark's cast only knows some spellings. ``1_000`` and
    non-ASCII decimal digits are numbers, as in Python.
    """

    def parsed(s):
        low = F.lower(s)
        return (
            F.when(~s.rlike(PY_FLOAT_RE), F.lit(None).cast("double"))
            .when(low.rlike("^[+-]?nan$"), F.lit(float("nan")))
            .when(low.rlike("^[+]?inf(inity)?$"), F.lit(float("inf")))
            .when(low.rlike("^-inf(inity)?$"), F.lit(float("-inf")))
            .otherwise(s.try_cast("double"))
        )

    # a one-element array binds the cleaned text, so it is made once
    return F.get(F.transform(F.array(_plain_number(col(c))), parsed), 0)


def g10(x) -> Column:
    """``f"{x:.10g}"`` for a double column (keeps ``-0`` like Python).

    ``%.9e`` gives the 10 significant digits and the exponent; the digits
    are then laid out in fixed or scientific form with zeros trimmed.
    Java rounds from the shortest decimal form of the double, Python from
    its exact binary value: results differ only for subnormals and for
    values whose 11th+ significant digits are a rounding tie.
    """
    x = col(x)
    e = F.format_string("%.9e", x)
    mant = F.substring_index(e, "e", 1)
    exp_txt = F.substring_index(e, "e", -1)
    expo = exp_txt.try_cast("int")
    unsigned = F.regexp_replace(mant, "^-", "")
    digits = F.regexp_replace(unsigned, r"\.", "")
    fixed_ip = F.when(expo >= 0, digits.substr(F.lit(1), expo + 1)).otherwise(F.lit("0"))
    fixed_fp = F.when(expo >= 0, digits.substr(expo + 2, F.lit(20))).otherwise(
        F.concat(F.repeat(F.lit("0"), -expo - 1), digits)
    )
    fixed_fp = F.rtrim(fixed_fp, F.lit("0"))
    fixed = F.when(fixed_fp == "", fixed_ip).otherwise(F.concat(fixed_ip, F.lit("."), fixed_fp))
    sci_m = F.regexp_replace(F.rtrim(unsigned, F.lit("0")), r"\.$", "")
    sci = F.concat(sci_m, F.lit("e"), exp_txt)
    body = F.when((expo >= -4) & (expo <= 9), fixed).otherwise(sci)
    out = F.concat(F.when(mant.startswith("-"), F.lit("-")).otherwise(F.lit("")), body)
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .otherwise(out)
    )


# --------------------------------------------------------------------------
# X1-X16
# --------------------------------------------------------------------------
def extract_answer(trace, which: str = "first") -> Column:
    """Text of the first ``Answer:`` line, stripped; NULL without one.

    The regex stops at the first match; its group is never empty on a match,
    so an empty extract means no marker. ``which='last'`` takes the last
    marker instead (documented variant, lists all matches).
    """
    if which == "last":
        return pystrip(F.try_element_at(F.regexp_extract_all(col(trace), F.lit(ANSWER_RE), F.lit(1)), F.lit(-1)))
    return pystrip(F.nullif(F.regexp_extract(col(trace), ANSWER_RE, 1), F.lit("")))


def has_answer_line(text) -> Column:
    """an answer marker followed by a non-space character."""
    return col(text).rlike(ANSWER_PRESENT_RE)


def count_answer_lines(text) -> Column:
    """Number of answer markers."""
    return F.regexp_count(col(text), F.lit(r"[Aa]nswer" + WS + r"*[:\-]"))


def norm_letter(s) -> Column:
    """First standalone choice letter A-E (case-insensitive), upper-cased."""
    return F.upper(F.nullif(F.regexp_extract(col(s), LETTER_RE, 1), F.lit("")))


def norm_math(s) -> Column:
    """Strip, drop trailing dots, unwrap \\boxed{}, delete $ and commas, strip."""
    t = F.rtrim(pystrip(col(s)), F.lit("."))
    t = F.regexp_replace(t, BOXED_RE, "$1")
    t = F.translate(t, "$,", "")
    return pystrip(t)


def gold_after_hashes(gold) -> Column:
    """Text after the last ``####`` (stripped) when present, else as is."""
    g = col(gold)
    return F.when(g.contains("####"), pystrip(F.substring_index(g, "####", -1))).otherwise(g)


def gold_gsm8k(answer_field) -> Column:
    """After the last ``####``; else the last number; else stripped text."""
    a = col(answer_field)
    last_num = F.try_element_at(F.regexp_extract_all(a, F.lit(NUMBER_RE), F.lit(0)), F.lit(-1))
    return (
        F.when(a.contains("####"), pystrip(F.substring_index(a, "####", -1)))
        .when(last_num.isNotNull(), last_num)
        .otherwise(pystrip(a))
    )


# Normalised answers with an exact rational value: a/b, \\frac{a}{b}, decimals.
_RATIONAL_RE = r"^([+-]?)(?:([0-9]+)/([0-9]+)|\\[dt]?frac\{([0-9]+)\}\{([0-9]+)\}|([0-9]*)(?:\.([0-9]*))?)$"


def rational(s) -> Column:
    """Exact value of a normalised answer as struct(sign, num, den), or NULL.

    Accepts integers, decimals, ``a/b`` and ``\\frac{a}{b}`` of any length;
    num and den are digit strings without leading zeros (zero: empty num),
    decimals without trailing zeros.
    """
    s = col(s)

    def g(i):
        return F.regexp_extract(s, _RATIONAL_RE, i)

    whole, part = g(6), F.rtrim(g(7), F.lit("0"))
    num = F.when(g(2) != "", g(2)).when(g(4) != "", g(4)).otherwise(F.concat(whole, part))
    den = F.when(g(2) != "", g(3)).when(g(4) != "", g(5)).otherwise(F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(part))))
    num, den = F.ltrim(num, F.lit("0")), F.ltrim(den, F.lit("0"))
    digits = F.concat(g(2), g(4), whole, g(7))
    ok = s.rlike(_RATIONAL_RE) & (F.length(digits) > 0) & (den != "")
    sign = F.when((g(1) == "-") & (num != ""), F.lit("-")).otherwise(F.lit(""))
    return F.when(ok, F.struct(sign.alias("sign"), num.alias("num"), den.alias("den")))


def rationals_equal(a: Column, b: Column) -> Column:
    """Equality of two ``rational`` values: by their digits, else by cross
    products of up to 38 digits; NULL values are not equal.

    Fractions whose cross products are longer and whose digits differ count
    as unequal.
    """

    def product(x, y):
        number = "decimal(38,0)"
        zero = F.when(x["num"] == "", F.lit("0")).otherwise(x["num"])
        return F.try_multiply(zero.try_cast(number), y["den"].try_cast(number))

    same = (a["num"] == b["num"]) & (a["den"] == b["den"])
    return F.coalesce((a["sign"] == b["sign"]) & (same | F.coalesce(product(a, b) == product(b, a), F.lit(False))), F.lit(False))


def float_equal(a, b) -> Column:
    """Python ``a == b`` on floats (NaN never equal)."""
    return (a == b) & ~F.isnan(a)


def arc_eval_equal(pred, gold) -> Column:
    """``upper(strip(pred or '')) == upper(strip(gold))``."""
    return F.upper(pystrip(F.coalesce(col(pred), F.lit("")))) == F.upper(pystrip(col(gold)))


def gsm8k_eval_equal(pred, gold) -> Column:
    """Float equality; when either side does not parse, stripped text equality."""
    p, g = col(pred), col(gold)
    pf, gf = py_float(norm_math(p)), py_float(norm_math(g))
    both = pf.isNotNull() & gf.isNotNull()
    res = F.when(both, float_equal(pf, gf)).otherwise(pystrip(p) == pystrip(g))
    return F.when(p.isNull(), F.lit(False)).otherwise(F.coalesce(res, F.lit(False)))


def approx_tokens(text) -> Column:
    """``max(1, len(text) // 4)``."""
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4).cast("int"))


def approx_tokens_raw(text) -> Column:
    """``len(text) // 4``, missing text counts as empty."""
    return F.floor(F.length(F.coalesce(col(text), F.lit(""))) / 4).cast("int")


def dedupe_key(question, trace) -> Column:
    """sha1 hex of lower(strip(q)) NUL strip(trace)[:200]."""
    return F.sha1(
        F.concat(
            F.lower(pystrip(col(question))),
            F.lit("\x00"),
            F.substring(pystrip(col(trace)), 1, 200),
        ).cast("binary")
    )


def logprob_weight(logprob_sum, length) -> Column:
    """``exp(sum / len)``, 1.0 when the length is not positive."""
    s, n = col(logprob_sum), col(length)
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.exp(s / n))


def rl_gold(meta_gold, response, exact_suffix: bool = False) -> Column:
    """``meta.gold`` if non-empty, else the text after the last ``Answer:``.

    Default trims the character *set* of ``<|im_end|>`` from the right like
    ``str.rstrip`` does (so ``dime`` loses its letters); ``exact_suffix``
    removes only the literal marker.
    """
    tail = pystrip(F.substring_index(col(response), "Answer:", -1))
    if exact_suffix:
        tail = F.when(
            tail.endswith(IM_END), tail.substr(F.lit(1), F.length(tail) - len(IM_END))
        ).otherwise(tail)
    else:
        tail = F.rtrim(tail, F.lit(IM_END))
    fallback = pystrip(tail)
    mg = col(meta_gold)
    return F.when(mg.isNotNull() & (mg != ""), mg).otherwise(fallback)


def completion_text(text=None, messages=None) -> Column:
    """Completion as text, or the content of the first chat message (default '')."""
    if messages is not None:
        first = F.get(col(messages), 0)
        msg_txt = F.coalesce(first.getField("content"), F.lit(""))
        if text is None:
            return msg_txt
        return F.coalesce(col(text), msg_txt)
    return col(text)


# --------------------------------------------------------------------------
# Staged forms. Nested Column functions repeat their inputs; for long
# traces that repeats regex work and can push generated code past the JVM
# method limit. These add one column per step so every expensive value is
# computed once per row (Catalyst keeps a Project whose expensive output is
# used more than once).
# --------------------------------------------------------------------------
def _tmp(df, name):
    return f"__{name}_{len(df.columns)}"


def with_vote_key(df, pred: str = "answer", task: str = "task", out: str = "key"):
    """Add X4 ``vote_key(pred, task)`` as column ``out``."""
    nm, num = _tmp(df, "nm"), _tmp(df, "num")
    staged = (
        df.withColumn(nm, norm_math(pred))
        .withColumn(num, py_float(F.col(nm)))
    )
    p, tk = F.col(pred), F.col(task)
    key = (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(tk == "arc", norm_letter(p))
        .when(tk.isin("gsm8k", "math"), F.when(F.col(num).isNotNull(), g10(F.col(num))).otherwise(F.col(nm)))
        .otherwise(F.lower(pystrip(p)))
    )
    return staged.withColumn(out, key).drop(nm, num)


def with_is_correct(df, pred: str = "answer", gold: str = "gold", task: str = "task", out: str = "correct", symbolic: bool = False):
    """Add X7 ``is_correct(pred, gold, task)`` as column ``out``.

    ``symbolic``: answers that are neither equal in form nor both numbers are
    compared by value (``functions.symbolic``); undecided ones stay unequal.
    """
    gn, pn, gnn, pf, gf, pr, gr = (_tmp(df, n) for n in ("gn", "pn", "gnn", "pf", "gf", "pr", "gr"))
    p, g, tk = F.col(pred), F.col(gold), F.col(task)
    staged = (
        df.withColumn(gn, gold_after_hashes(g))
        .withColumn(pn, norm_math(p))
        .withColumn(gnn, norm_math(F.col(gn)))
        .withColumn(pf, py_float(F.col(pn)))
        .withColumn(gf, py_float(F.col(gnn)))
    )
    # the exact rational parse only runs where cheaper rules cannot decide
    undecided = (
        p.isNotNull()
        & tk.isin("gsm8k", "math")
        & ~F.coalesce(F.col(pn) == F.col(gnn), F.lit(False))
        & ~((tk == "gsm8k") & F.col(pf).isNotNull() & F.col(gf).isNotNull())
    )
    staged = staged.withColumn(pr, F.when(undecided, rational(F.col(pn)))).withColumn(
        gr, F.when(undecided, rational(F.col(gnn)))
    )
    r_eq = rationals_equal(F.col(pr), F.col(gr))
    m_eq = F.coalesce(F.col(pn) == F.col(gnn), F.lit(False)) | r_eq
    if symbolic:
        staged, by_value = _with_value_equal(staged, p, F.col(gn), undecided & ~(F.col(pr).isNotNull() & F.col(gr).isNotNull()))
        m_eq = m_eq | F.col(by_value)
    gsm = F.when(F.col(pf).isNotNull() & F.col(gf).isNotNull(), float_equal(F.col(pf), F.col(gf))).otherwise(m_eq)
    res = (
        F.when(tk == "arc", norm_letter(p).eqNullSafe(norm_letter(g)))
        .when(tk == "gsm8k", gsm)
        .when(tk == "math", m_eq)
        .otherwise(F.lower(pystrip(p)) == F.lower(pystrip(g)))
    )
    val = F.when(p.isNull(), F.lit(False)).otherwise(F.coalesce(res, F.lit(False)))
    staged = staged.withColumn(out, val).drop(gn, pn, gnn, pf, gf, pr, gr)
    return staged.drop(by_value) if symbolic else staged


def _with_value_equal(df, pred: Column, gold: Column, where: Column):
    """(df with a column of equality by value where ``where`` holds and it is decided, its name)."""
    from thinkframe.functions.symbolic import with_symbolic_equal

    a, b, name = _tmp(df, "sa"), _tmp(df, "sb"), _tmp(df, "by_value")
    df = df.withColumn(a, F.when(where, pred)).withColumn(b, F.when(where, gold))
    return with_symbolic_equal(df, a, b, name).withColumn(name, F.coalesce(F.col(name), F.lit(False))).drop(a, b), name


def with_math_equal(df, pred: str, gold: str, out: str, symbolic: bool = False):
    """Add X8 ``math_equal(pred, gold)`` as column ``out`` (``symbolic``: see ``with_is_correct``)."""
    pn, gnn, pr, gr = (_tmp(df, n) for n in ("pn", "gnn", "pr", "gr"))
    staged = (
        df.withColumn(pn, norm_math(pred))
        .withColumn(gnn, norm_math(gold))
    )
    undecided = ~F.coalesce(F.col(pn) == F.col(gnn), F.lit(True))
    staged = staged.withColumn(pr, F.when(undecided, rational(F.col(pn)))).withColumn(
        gr, F.when(undecided, rational(F.col(gnn)))
    )
    r_eq = rationals_equal(F.col(pr), F.col(gr))
    m_eq = F.coalesce(F.col(pn) == F.col(gnn), F.lit(False)) | r_eq
    if symbolic:
        p, g = (F.col(c) if isinstance(c, str) else c for c in (pred, gold))
        staged, by_value = _with_value_equal(staged, p, g, undecided & ~(F.col(pr).isNotNull() & F.col(gr).isNotNull()))
        return staged.withColumn(out, m_eq | F.col(by_value)).drop(pn, gnn, pr, gr, by_value)
    return staged.withColumn(out, m_eq).drop(pn, gnn, pr, gr)
