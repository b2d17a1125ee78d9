"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the hash selects a declared mapping
(for a typed table with further columns, the largest declared layout that its
columns hold) that turns the record's layout (one row per turn, a list of messages, prompt
and response, instruction with input and output) into canonical turns
(conversation, turn, role, text). Typed tables have one fingerprint, taken
from their schema; JSON records have one each. JSON records without a mapping or
without a turn come back as such, with their fingerprint, and are never dropped.

The template marks turns as ``<|im_start|>role\\n ... <|im_end|>\\n``. Inside
texts and roles a backslash is doubled and one is put into every control
string, so no text can open or close a turn, and ``unescaped`` gives every
text back exactly. Formatted turns are rows, so a conversation of any length
needs bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Control strings of common chat templates that a text must not hold.
CONTROL = r"(<)(\||/?s>|<SYS>>|</SYS>>)|(\[)(/?INST\])"

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A mapping for records with these field paths.

    ``rows``: (conversation, turn, role, text) fields of one turn per row;
    ``messages``: (list, role, text) fields; ``fixed``: (role, fields) per
    turn, whose non-empty fields are joined by a line end; a turn whose fields
    are all empty is left out.
    """

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str, str] | None = None
    messages: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), messages=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
    Layout("instruction", ("instruction", "input", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction only", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt completion", ("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system prompt", ("system", "prompt", "response"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("question", "answer"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)


def shape(paths: Sequence[str]) -> str:
    """Field paths as one nested text, names in order: OBJECT<a, b: ARRAY<OBJECT<c>>>."""
    inner: dict[str, list[str]] = {}
    for path in paths:
        head, _, tail = path.partition(".")
        inner.setdefault(head, [])
        if tail:
            inner[head].append(tail)
    parts = []
    for name in sorted(inner, key=lambda x: x.removesuffix("[]")):
        below = shape(inner[name]) if inner[name] else ""
        if name.endswith("[]"):
            below = f"ARRAY<{below}>"
        parts.append(name.removesuffix("[]") + (f": {below}" if below else ""))
    return f"OBJECT<{', '.join(parts)}>"


def paths_of(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a typed table."""
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, prefix + "[]")
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    return [prefix]


def fingerprint(paths: Sequence[str]) -> str:
    return hashlib.sha256(shape(paths).encode()).hexdigest()


def fingerprint_of_json(raw: Column) -> Column:
    """The same fingerprint for a JSON text (null or broken: null)."""
    return F.sha2(_untyped(F.schema_of_variant(F.try_parse_json(raw))), 256)


def _untyped(typed: Column) -> Column:
    """A variant's schema text without the types of its leaves."""
    bare = F.regexp_replace(typed, r": (?!OBJECT<|ARRAY<)[A-Z]+(?:\([0-9, ]+\))?", "")
    return F.regexp_replace(bare, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z]+(?:\([0-9, ]+\))?>", "ARRAY<>")


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(known[F.coalesce(role, F.lit(""))], role, F.lit(""))


def _numbered(df: DataFrame, key: str, turns: Column) -> DataFrame:
    listed = df.select(F.col(key).cast("long").alias("conv_id"), F.posexplode(turns).alias("turn", "t"))
    return listed.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("t.role")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def _messages(listed: Column, role: str, text: str) -> Column:
    return F.transform(listed, lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))


def _fixed(layout: Layout, field) -> Column:
    turns = []
    for role, names in layout.fixed:
        filled = F.filter(F.array(*[field(n) for n in names]), lambda x: F.coalesce(x, F.lit("")) != "")
        turns.append(F.struct(F.lit(role).alias("role"), F.when(F.size(filled) > 0, F.array_join(filled, "\n")).alias("text")))
    return F.filter(F.array(*turns), lambda t: t["text"].isNotNull())


def layout_of(paths: Sequence[str], key: str, layouts: Sequence[Layout] = LAYOUTS) -> Layout:
    """The layout whose fingerprint the paths have (with or without ``key``);
    else, of the layouts whose paths are all among them, the one with the most.
    None, or several with as many, raise ValueError."""
    by_print = {fingerprint(x.paths): x for x in layouts}
    for own in (list(paths), [p for p in paths if p != key]):
        if (layout := by_print.get(fingerprint(own))) is not None:
            return layout
    held = [x for x in layouts if set(x.paths) <= set(paths)]
    most = [x for x in held if len(x.paths) == max(len(y.paths) for y in held)]
    if len(most) != 1:
        what = "no mapping" if not most else f"several mappings ({', '.join(x.name for x in most)})"
        raise ValueError(f"{what} for the layout {shape(paths)}")
    return most[0]


def canonical_turns(records: DataFrame, key: str = "conv_id", ignore: Sequence[str] = (), layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a typed table.

    The schema's fingerprint selects the layout (see ``layout_of``); columns
    beside the layout's own, and those in ``ignore``, are not read. Null roles
    and texts are empty. A record whose list is null or empty, or whose fields
    are all empty, has no turns and so no rows here. A schema without a
    mapping, or with several equally large ones, raises ValueError.
    """
    paths = [p for f in records.schema.fields if f.name not in ignore for p in paths_of(f.dataType, f.name)]
    layout = layout_of(paths, key, layouts)
    if layout.rows:
        conv, turn, role, text = layout.rows
        return records.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), _role(F.col(role)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if layout.messages:
        field, role, text = layout.messages
        return _numbered(records, key, _messages(F.col(field), role, text))
    return _numbered(records, key, _fixed(layout, F.col))


def canonical_turns_of_json(records: DataFrame, key: str, raw: str, layouts: Sequence[Layout] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """(turns, unmapped) of JSON records of mixed layouts.

    ``unmapped`` holds (key, raw, fingerprint) of every record without a turn:
    broken ones, layouts without a mapping, empty lists and empty fields.
    """
    mapped = [x for x in layouts if not x.rows]
    marked = records.select(F.col(key).alias("k"), F.col(raw).alias("r"), fingerprint_of_json(F.col(raw)).alias("fingerprint"))
    turns = F.lit(None)
    for x in mapped:
        if x.messages:
            field, role, text = x.messages
            parsed = F.from_json("r", f"`{field}` array<struct<`{role}` string, `{text}` string>>")[field]
            own = _messages(parsed, role, text)
        else:
            own = _fixed(x, lambda n: F.get_json_object("r", f"$.{n}"))
        turns = F.when(F.col("fingerprint") == fingerprint(x.paths), own).otherwise(turns)
    marked = marked.withColumn("turns", turns)
    some = F.coalesce(F.size("turns") > 0, F.lit(False))
    return _numbered(marked.where(some), "k", F.col("turns")), marked.where(~some).select(F.col("k").alias(key), F.col("r").alias(raw), "fingerprint")


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1$3\\\\$2$4")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_length) per turn.

    A conversation's text is its segments put together. The loss mask covers
    ``loss_length`` code points from ``loss_start`` (0-based) of the segment:
    the texts of ``trained`` roles; other roles have length 0.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    out = turns.select("conv_id", "turn", F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"), F.col("role").isin(list(trained)).alias("learn"))
    return out.select(
        "conv_id", "turn", F.concat("head", "body", F.lit(CLOSE)).alias("segment"),
        F.length("head").alias("loss_start"), F.when(F.col("learn"), F.length("body")).otherwise(0).alias("loss_length"),
    )


def parsed(segments: DataFrame) -> DataFrame:
    """Formatted turns back to (conv_id, turn, role, text, loss_text, chars)."""
    head = F.regexp_extract("segment", r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n", 1)
    start = F.length(F.lit(OPEN)) + F.length(head) + 1
    body = F.expr("substring(segment, __start + 1, length(segment) - __start - length('<|im_end|>') - 1)")
    return segments.withColumn("__head", head).withColumn("__start", start).select(
        "conv_id", "turn", unescaped(F.col("__head")).alias("role"), unescaped(body).alias("text"),
        unescaped(F.expr("substring(segment, loss_start + 1, loss_length)")).alias("loss_text"), F.length("segment").alias("chars"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``parsed`` turns: counts and hashes.

    Turns stream in order (turn, then role and text among equal numbers; null
    first) through running hashes, so a conversation of any length takes
    constant memory in the one task that its sequential hash needs.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing = object()
        now, done, state = missing, [], None

        def row():
            n, whole, chars, loss, size = state
            return now, n, whole.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            for conv, role, text, loss_text, size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if conv != now or now is missing:
                    if now is not missing:
                        done.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss_text)
                state[3].update(loss_text.encode())
                state[4] += size
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done = []
        if now is not missing:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), types, strict=True)], names=names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "role", "text", "loss_text", "chars").mapInArrow(digest, schema)
