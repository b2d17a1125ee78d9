"""X8 beyond normal forms: equality of answers by value, as Column expressions.

An answer gets a canonical text that depends on its value only, or NULL where
it cannot be read; two answers are equal if their texts are, and undecided if
either is NULL. No pair is looked at, so the text can also be grouped by.

1. LaTeX and plain spellings become one alphabet (fractions, roots, products,
   matrices, sets; thousands separators go).
2. Structure: a fold over brackets and commas with a stack of open brackets
   finds tuples, intervals, sets, matrices and bare lists (a bare list is a
   set) of any depth. Brackets without a comma group an expression.
3. Every member is an expression: tokens, implicit products, then a
   shunting-yard fold to reverse Polish order.
4. Values are taken modulo three fixed primes: a fold over a stack of fractions,
   letters (and pi) at points chosen by their hash. Different polynomials and
   rational functions agree there with a chance below degree / 2^31 per prime
   (identity testing); different numbers, if no such prime divides their
   difference.
5. Square roots of fractions whose primes are at most 47: modulo each of the
   primes, all those have a square root, and n -> n^((p+1)/4) picks them
   consistently (it is multiplicative), so sums and products of roots keep
   their relations: sqrt(8) = 2 sqrt(2), (1+sqrt(2))^2 = 3+2 sqrt(2).
6. A second fold puts the members together; those of sets are sorted and
   single.

Not read, so undecided: other functions and commands, other and nested roots,
powers that are not whole numbers, mixed numbers (``2\\frac{1}{2}``), words,
units, divisions by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinkframe.functions.text import pystrip

# p = 7 mod 8 for which every prime up to SMOOTH is a square; tests check the rule.
PRIMES = (2147260631, 2146303871, 2143697111)
SMOOTH = 47
EXACT = 10**9  # largest numerator and denominator that are also kept as they are
MOST_TOKENS = 512
MOST_POWER = 512

VARIABLES = r"\\(?:pi|infty|alpha|beta|gamma|theta|lambda|mu|phi|omega)"
_LEXEME = rf"[0-9]+(?:\.[0-9]*)?|\.[0-9]+|{VARIABLES}(?![a-zA-Z])|\\frac|\\sqrt|[a-zA-Z]|[-+*/^(){{}}]"

# One sign per bracket: sets, matrices (rows are matrices too), and in the
# second fold composites: open + two signs for the kind, separator, close.
SET, MATRIX = "⦃⦄", "⟦⟧"
OPEN, NEXT, CLOSE = "⟪", "⸱", "⟫"


def _bits(n: int) -> str:
    return f"array({','.join(bin(n)[2:])})"


_P = f"array({', '.join(f'{p}L' for p in PRIMES)})"
_ROOT = f"array({', '.join(_bits((p + 1) // 4) for p in PRIMES)})"
_INVERSE = f"array({', '.join(_bits(p - 2) for p in PRIMES)})"


def _powers_of_small_primes() -> str:
    primes = [q for q in range(2, SMOOTH + 1) if all(q % r for r in range(2, q))]
    return ", ".join(f"{q ** (1 << j)}L" for q in primes for j in range(5, -1, -1) if q ** (1 << j) <= EXACT**2)


# --------------------------------------------------------------------------
# one alphabet
# --------------------------------------------------------------------------
def plain(s: Column) -> Column:
    """The answer in one spelling, without white space."""
    t = F.rtrim(pystrip(s), F.lit("."))
    t = F.regexp_replace(t, r"^\$*\\boxed\{(.*)\}\$*$", "$1")
    for pattern, new in (
        (r"\\\\\s*", "⟧,⟦"),  # the end of a matrix row
        (r"\\[dtc]frac(?![a-zA-Z])", r"\\frac"),
        (r"\\(?:cdot|times)(?![a-zA-Z])|\*(?!\*)(?<!\*\*)|[·×⋅]", "*"),
        (r"\*\*", "^"),
        (r"\\div(?![a-zA-Z])|÷", "/"),
        (r"\\sqrt\s+([0-9a-zA-Z])", r"\\sqrt{$1}"),
        (rf"({VARIABLES})\s+(?=[a-zA-Z])", "$1*"),
        (r"\\left(?![a-zA-Z])|\\right(?![a-zA-Z])|\\displaystyle(?![a-zA-Z])|\\[,;:! ]|[$~\s]", ""),
        ("[−–]", "-"),
        ("π", r"\\pi"),
        ("∞", r"\\infty"),
        (r"\\emptyset(?![a-zA-Z])|\\varnothing(?![a-zA-Z])|∅", SET),
        (r"\\begin\{[pbv]?matrix\}", "⟦⟦"),
        (r"(?:⟧,⟦)?\\end\{[pbv]?matrix\}", "⟧⟧"),
        ("&", ","),
        (r"\\\{|\\lbrace(?![a-zA-Z])", "⦃"),
        (r"\\\}|\\rbrace(?![a-zA-Z])", "⦄"),
        (r"\\frac([0-9])([0-9])", r"\\frac{$1}{$2}"),
        (r"\\frac([0-9])\{", r"\\frac{$1}{"),
        (r"(\\frac\{[^{}]*\})([0-9a-zA-Z])", "$1{$2}"),
        (r"\\sqrt([0-9a-zA-Z])", r"\\sqrt{$1}"),
        (r"√([0-9]+|[a-zA-Z])", r"\\sqrt{$1}"),
        (r"√(?=\()", r"\\sqrt"),
        (r"^[a-zA-Z]=(?=[^=]+$)", ""),
    ):
        t = F.regexp_replace(t, pattern, new)
    return F.when(t.rlike(r"[(\[⟦⦃]"), t).otherwise(F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", ""))


# --------------------------------------------------------------------------
# structure
# --------------------------------------------------------------------------
def _frame(open_: str, cur: str, mem: str) -> str:
    return f"named_struct('open', {open_}, 'cur', {cur}, 'mem', {mem})"


def _structure(t: str) -> str:
    """Text with composites marked (see OPEN), NULL if brackets do not match."""
    top, below, n = "element_at(s.stack, -1)", "try_element_at(s.stack, -2)", "size(s.stack)"
    none = "cast(array() as array<string>)"

    def state(ok: str, stack: str) -> str:
        return f"named_struct('ok', {ok}, 'stack', {stack})"

    def top_with(cur: str, mem: str) -> str:
        return f"concat(slice(s.stack, 1, {n} - 1), array({_frame(f'{top}.open', cur, mem)}))"

    def below_with(cur: str) -> str:
        return f"concat(slice(s.stack, 1, {n} - 2), array({_frame(f'{below}.open', cur, f'{below}.mem')}))"

    kind = f"concat({top}.open, t)"
    members = f"if({top}.cur = '', {top}.mem, concat({top}.mem, array({top}.cur)))"
    step = f"""CASE WHEN NOT s.ok THEN s
      WHEN t IN ('(', '[', '⟦', '⦃') THEN {state(f"NOT contains({top}.cur, '{OPEN}')", f"concat(s.stack, array({_frame('t', "''", none)}))")}
      WHEN t = ',' THEN {state(f"{top}.cur <> ''", top_with("''", f"concat({top}.mem, array({top}.cur))"))}
      WHEN t IN (')', ']', '⟧', '⦄') THEN CASE
        WHEN {n} < 2 OR {kind} NOT IN ('()', '(]', '[)', '[]', '{MATRIX}', '{SET}') THEN {state("false", "s.stack")}
        WHEN {kind} = '()' AND size({top}.mem) = 0 THEN {state(f"{top}.cur <> '' AND NOT contains({top}.cur, '{OPEN}')", below_with(f"concat({below}.cur, '(', {top}.cur, ')')"))}
        ELSE {state(f"{below}.cur = '' AND ({top}.cur <> '' OR ({kind} = '{SET}' AND size({top}.mem) = 0))", below_with(f"concat('{OPEN}', {kind}, concat_ws('{NEXT}', {members}), '{CLOSE}')"))} END
      ELSE {state(f"NOT contains({top}.cur, '{OPEN}')", top_with(f"concat({top}.cur, t)", f"{top}.mem"))} END"""
    last = f"""CASE WHEN NOT s.ok OR {n} <> 1 OR {top}.cur = '' THEN NULL WHEN size({top}.mem) = 0 THEN {top}.cur
      ELSE concat('{OPEN}{SET}', concat_ws('{NEXT}', {members}), '{CLOSE}') END"""
    signs = r"[(\\[⟦⦃)\\]⟧⦄,]|[^(\\[⟦⦃)\\]⟧⦄,]+"
    return f"aggregate(regexp_extract_all({t}, '{signs}', 0), {state('true', f'array({_frame(chr(39) * 2, chr(39) * 2, none)})')}, (s, t) -> {step}, s -> {last})"


# --------------------------------------------------------------------------
# expressions
# --------------------------------------------------------------------------
def _sql(pattern: str) -> str:
    """A regular expression as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _lexed(t: str) -> str:
    """Tokens in which products are explicit, ``u`` is the minus sign of one
    operand, ``r`` a root, ``÷`` a fraction's bar; NULL if the text is not read."""
    variable = rf"^(?:[a-zA-Z]|{VARIABLES})$"
    starts = f"(x = '(' OR x IN ('\\\\sqrt', '\\\\frac') OR x RLIKE {_sql(variable)})"
    before = "if(i = 0, '', r[i - 1])"
    ends = f"({before} IN (')', '}}') OR {before} RLIKE {_sql('^[0-9.]')} OR {before} RLIKE {_sql(variable)})"
    follows = "coalesce(try_element_at(r, i + 2), '')"
    alone = f"({before} = '' OR {before} IN ('(', '{{', '+', '-', '*', '/', '^'))"
    own = f"""CASE WHEN x = '\\\\frac' THEN cast(array() as array<string>) WHEN x = '\\\\sqrt' THEN array('r') WHEN x = '{{' THEN array('(')
      WHEN x = '}}' THEN if({follows} = '{{', array(')', '÷'), array(')'))
      WHEN x IN ('+', '-') AND {alone} THEN if(x = '-', array('u'), cast(array() as array<string>))
      WHEN x RLIKE {_sql(variable)} THEN array(concat('v', x)) ELSE array(x) END"""
    bare = f"regexp_replace({t}, {_sql('[\\\\][a-zA-Z]+')}, ' ')"
    unread = " OR ".join([
        f"array_join(r, '') <> {t}", f"size(r) > {MOST_TOKENS}",
        f"{t} RLIKE {_sql(r'[0-9.]\\frac|[a-zA-Z)}][0-9.]|\.[0-9]*\.|\\sqrt[^{(]')}",
        f"{bare} RLIKE '[a-zA-Z]{{3}}|^[a-zA-Z]{{2}}$'",
        f"regexp_count({t}, {_sql(r'\\frac')}) <> regexp_count({t}, {_sql(r'\}\{')})",
    ])
    tokens = f"flatten(transform(r, (x, i) -> concat(if({starts} AND {ends}, array('*'), cast(array() as array<string>)), {own})))"
    return f"element_at(transform(array(regexp_extract_all({t}, {_sql(_LEXEME)}, 0)), r -> if({unread}, NULL, {tokens})), 1)"


def _reverse_polish(tokens: str) -> str:
    """Shunting yard; brackets that do not match are left in the result."""
    rank = "element_at(map('(', 0, '+', 1, '-', 1, '*', 2, '/', 2, 'u', 3, '^', 4, '÷', 5, 'r', 6), {})"
    o, t = rank.format("o"), rank.format("t")
    stop = f"(o = '(' OR {o} < {t} OR ({o} = {t} AND t = '^'))"
    stops = f"array_position(transform(reverse(s.ops), o -> {stop}), true)"
    popped = f"cast(if({stops} = 0, size(s.ops), {stops} - 1) as int)"
    inside = "cast(array_position(reverse(s.ops), '(') as int)"
    step = f"""CASE WHEN t RLIKE '^[0-9.v]' THEN named_struct('out', concat(s.out, array(t)), 'ops', s.ops)
      WHEN t IN ('(', 'u', 'r') THEN named_struct('out', s.out, 'ops', concat(s.ops, array(t)))
      WHEN t = ')' THEN if({inside} = 0, named_struct('out', concat(s.out, array(')')), 'ops', s.ops),
        named_struct('out', concat(s.out, slice(reverse(s.ops), 1, {inside} - 1)), 'ops', slice(s.ops, 1, size(s.ops) - {inside})))
      ELSE named_struct('out', concat(s.out, slice(reverse(s.ops), 1, {popped})), 'ops', concat(slice(s.ops, 1, size(s.ops) - {popped}), array(t))) END"""
    none = "cast(array() as array<string>)"
    return f"aggregate({tokens}, named_struct('out', {none}, 'ops', {none}), (s, t) -> {step}, s -> concat(s.out, reverse(s.ops)))"


def _value(n: str, d: str, a: str, b: str) -> str:
    """A fraction: numerators and denominators modulo the primes; the fraction a / b itself if small."""
    fits = f"coalesce(abs({a}) <= {EXACT} AND {b} BETWEEN 1 AND {EXACT}, false)"
    return f"named_struct('n', {n}, 'd', {d}, 'a', if({fits}, {a}, NULL), 'b', if({fits}, {b}, NULL))"


def _number() -> str:
    digits, places = "replace(t, '.', '')", "if(instr(t, '.') > 0, length(t) - instr(t, '.'), 0)"
    n = f"transform({_P}, p -> aggregate(split({digits}, ''), 0L, (m, c) -> if(c = '', m, (m * 10 + cast(c as bigint)) % p)))"
    d = f"transform({_P}, p -> aggregate(split(repeat('0', {places}), ''), 1L, (m, c) -> if(c = '', m, m * 10 % p)))"
    return _value(n, d, f"if(length({digits}) <= 10, cast({digits} as bigint), NULL)", f"if({places} <= 9, cast(concat('1', repeat('0', {places})) as bigint), NULL)")


def _variable() -> str:
    return _value(f"transform({_P}, p -> 1 + pmod(xxhash64(t, p), p - 1))", f"transform({_P}, p -> 1L)", "cast(NULL as bigint)", "cast(NULL as bigint)")


def _power(base: str, bits: str) -> str:
    return f"aggregate({bits}, 1L, (m, bit) -> (m * m % p) * if(bit = 1, {base}, 1L) % p)"


def _root(x: str) -> str:
    """The value of a square root; NULL if it is not read."""
    m = f"({x}.a * {x}.b)"
    smooth = f"({m} = 0 OR aggregate(array({_powers_of_small_primes()}), {m}, (m, f) -> if(m % f = 0, m div f, m)) = 1)"
    whole = f"cast(round(sqrt(cast({m} as double))) as bigint)"
    value = _value(f"transform({_P}, (p, i) -> {_power(f'({m} % p)', f'{_ROOT}[i]')})", f"transform({_P}, p -> {x}.b % p)", f"if({whole} * {whole} = {m}, {whole}, NULL)", f"{x}.b")
    return f"if(coalesce({x}.a >= 0 AND {smooth}, false), {value}, NULL)"


def _binary() -> str:
    """The value of ``v.x t v.y``; NULL if it is not read."""
    x, y = "v.x", "v.y"
    cross = f"{x}.n[i] * {y}.d[i]", f"{y}.n[i] * {x}.d[i]"
    n = f"transform({_P}, (p, i) -> CASE t WHEN '+' THEN ({cross[0]} + {cross[1]}) % p WHEN '-' THEN ({cross[0]} % p + p - {cross[1]} % p) % p WHEN '*' THEN {x}.n[i] * {y}.n[i] % p ELSE {cross[0]} % p END)"
    over = "t IN ('/', '÷')"
    d = f"transform({_P}, (p, i) -> if({over}, {x}.d[i] * {y}.n[i], {x}.d[i] * {y}.d[i]) % p)"
    a = f"CASE t WHEN '+' THEN {x}.a * {y}.b + {y}.a * {x}.b WHEN '-' THEN {x}.a * {y}.b - {y}.a * {x}.b WHEN '*' THEN {x}.a * {y}.a ELSE {x}.a * {y}.b * sign({y}.a) END"
    b = f"if({over}, {x}.b * abs({y}.a), {x}.b * {y}.b)"
    plain_ = _value(n, d, f"cast({a} as bigint)", b)
    bits = f"transform(sequence(9, 0, -1), k -> cast(shiftright(abs({y}.a), k) & 1 as int))"
    up, down = f"if({y}.a >= 0, {x}.n[i], {x}.d[i])", f"if({y}.a >= 0, {x}.d[i], {x}.n[i])"
    pa, pb = f"pow(cast(if({y}.a >= 0, {x}.a, {x}.b) as double), abs({y}.a))", f"pow(cast(if({y}.a >= 0, {x}.b, {x}.a) as double), abs({y}.a))"
    small = [f"if(abs({z}) <= {EXACT}, cast({z} as bigint), NULL)" for z in (pa, pb)]
    raised = _value(f"transform({_P}, (p, i) -> {_power(up, bits)})", f"transform({_P}, (p, i) -> {_power(down, bits)})", *small)
    return f"""CASE WHEN t <> '^' THEN {plain_} WHEN {y}.a = 1 AND {y}.b = 2 THEN {_root(x)}
      WHEN coalesce({y}.b = 1 AND abs({y}.a) <= {MOST_POWER} AND NOT ({y}.a = 0 AND coalesce({x}.a = 0, false)), false) THEN {raised} END"""


def _key(polish: str) -> str:
    """The value's residues as a text; NULL if it has none."""
    top = "element_at(s.st, -1)"
    n = "size(s.st)"
    negative = _value(f"transform({_P}, (p, i) -> (p - {top}.n[i]) % p)", f"{top}.d", f"-{top}.a", f"{top}.b")

    def pushed(less: int, value: str) -> str:
        return f"element_at(transform(array({value}), w -> if(w IS NULL, named_struct('ok', false, 'st', s.st), named_struct('ok', true, 'st', concat(slice(s.st, 1, {n} - {less}), array(w))))), 1)"

    pair = "named_struct('x', element_at(s.st, -2), 'y', element_at(s.st, -1))"
    binary = f"element_at(transform(array({pair}), v -> {_binary()}), 1)"
    step = f"""CASE WHEN NOT s.ok THEN s WHEN t RLIKE '^[0-9.]' THEN {pushed(0, _number())} WHEN t LIKE 'v%' THEN {pushed(0, _variable())}
      WHEN t = 'u' AND {n} >= 1 THEN {pushed(1, negative)} WHEN t = 'r' AND {n} >= 1 THEN {pushed(1, _root(top))}
      WHEN t IN ('+', '-', '*', '/', '÷', '^') AND {n} >= 2 THEN {pushed(2, binary)}
      ELSE named_struct('ok', false, 'st', s.st) END"""
    value = f"transform({_P}, (p, i) -> cast({top}.n[i] * {_power(f'{top}.d[i]', f'{_INVERSE}[i]')} % p as string))"
    last = f"if(s.ok AND {n} = 1 AND forall({top}.d, x -> x <> 0), concat_ws(',', {value}), NULL)"
    none = "cast(array() as array<struct<n:array<bigint>,d:array<bigint>,a:bigint,b:bigint>>)"
    return f"aggregate({polish}, named_struct('ok', true, 'st', {none}), (s, t) -> {step}, s -> {last})"


# --------------------------------------------------------------------------
# members put together
# --------------------------------------------------------------------------
def _together(tokens: str, keys: str) -> str:
    top, n = "element_at(s, -1)", "size(s)"
    none = "cast(array() as array<string>)"

    def appended(frame: str, less: int, what: str) -> str:
        return f"concat(slice(s, 1, {n} - {less}), array(named_struct('kind', {frame}.kind, 'mem', concat({frame}.mem, array({what})))))"

    members = f"if({top}.kind = '{SET}', array_sort(array_distinct({top}.mem)), {top}.mem)"
    closed = f"concat({top}.kind, '{{', concat_ws(';', {members}), '}}')"
    step = f"""CASE WHEN z.t LIKE '{OPEN}%' THEN concat(s, array(named_struct('kind', substring(z.t, 2, 2), 'mem', {none})))
      WHEN z.t = '{NEXT}' THEN s WHEN z.t = '{CLOSE}' THEN {appended("element_at(s, -2)", 2, closed)} ELSE {appended(top, 1, "z.k")} END"""
    zipped = f"zip_with({tokens}, {keys}, (t, k) -> named_struct('t', t, 'k', coalesce(k, '')))"
    start = f"array(named_struct('kind', '', 'mem', {none}))"
    return f"aggregate({zipped}, {start}, (s, z) -> {step}, s -> element_at(s[0].mem, 1))"


_MARK = f"'^[{OPEN}{NEXT}{CLOSE}]'"


def with_canonical(df: DataFrame, answer: Column | str, out: str) -> DataFrame:
    """Add the canonical text of an answer as column ``out`` (NULL: not read).

    Texts are equal if and only if the answers have one structure and their
    members one value (see the module's text for what is read and with what
    certainty). Each step is a column of its own, made once per row; a NULL
    answer passes through all of them at once.
    """
    names = [f"__{out}_{step}" for step in ("plain", "shape", "tokens", "lexed", "polish", "keys")]
    text, shape, tokens, lexed, polish, keys = names
    c = F.col(answer) if isinstance(answer, str) else answer
    df = df.withColumn(text, plain(c)).withColumn(shape, F.expr(_structure(f"`{text}`")))
    df = df.withColumn(tokens, F.expr(f"regexp_extract_all(`{shape}`, '{OPEN}..|{CLOSE}|{NEXT}|[^{OPEN}{CLOSE}{NEXT}]+', 0)"))
    df = df.withColumn(lexed, F.expr(f"transform(`{tokens}`, t -> if(t RLIKE {_MARK}, NULL, {_lexed('t')}))"))
    df = df.withColumn(polish, F.expr(f"transform(`{lexed}`, x -> {_reverse_polish('x')})"))
    df = df.withColumn(keys, F.expr(f"transform(`{polish}`, x -> {_key('x')})"))
    unread = f"exists(zip_with(`{tokens}`, `{keys}`, (t, k) -> NOT t RLIKE {_MARK} AND k IS NULL), x -> x)"
    return df.withColumn(out, F.expr(f"if({unread}, NULL, {_together(f'`{tokens}`', f'`{keys}`')})")).drop(*names)


def with_symbolic_equal(df: DataFrame, pred: Column | str, gold: Column | str, out: str) -> DataFrame:
    """Add whether two answers are equal by value; NULL where either is not read."""
    a, b = f"__{out}_a", f"__{out}_b"
    df = with_canonical(with_canonical(df, pred, a), gold, b)
    return df.withColumn(out, F.col(a) == F.col(b)).drop(a, b)
