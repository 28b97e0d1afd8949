"""Chat formatting: a fingerprint of nested field paths picks the mapping to canonical turns; a reversible template formats them.

All of it is column expressions.
"""

from __future__ import annotations

import struct

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layout: its field paths (those of a list's entries in braces), then how its turns are made. A ``list`` names the entries'
#: role and text fields; ``pair`` names the fields of a user and an assistant turn; ``rows`` has a turn in each row.
MAPPINGS: dict[str, tuple[str, tuple]] = {
    "rows": ("role{},text{},turn{}", ("rows",)),
    "messages": ("messages{content,role}", ("list", "messages", "role", "content")),
    "from_value": ("conversations{from,value}", ("list", "conversations", "from", "value")),
    "turns": ("turns{role,text}", ("list", "turns", "role", "text")),
    "instruction": ("input{},instruction{},output{}", ("pair", ("instruction", "input"), "output")),
    "short_instruction": ("instruction{},output{}", ("pair", ("instruction",), "output")),
    "completion": ("completion{},prompt{}", ("pair", ("prompt",), "completion")),
    "response": ("prompt{},response{}", ("pair", ("prompt",), "response")),
    "question": ("answer{},question{}", ("pair", ("question",), "answer")),
}
#: Names that list layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
OPEN, CLOSE = "<turn>", "</turn>\n"
_TURNS = "array<struct<role:string,text:string>>"
_FIELDS = [p.split("{") for paths, _ in MAPPINGS.values() for p in paths.replace("},", "}\n").split("\n")]
_KNOWN = sorted({name for name, _ in _FIELDS})
_ENTRY = sorted({f for _, entry in _FIELDS for f in entry[:-1].split(",") if f})


def schema_paths(schema: T.StructType) -> str:
    """The known top-level fields, sorted, each with the known fields of its entries if it is a list of structs."""
    out = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        if f.name in _KNOWN:
            entry = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else None
            out.append(f.name + "{" + (",".join(x for x in sorted(entry.names) if x in _ENTRY) if isinstance(entry, T.StructType) else "") + "}")
    return ",".join(out)


def json_paths(payload: Column) -> Column:
    """The same for a JSON object's text, row by row, from the first entry of each list."""
    keys = F.filter(F.array_sort(F.json_object_keys(payload)), lambda k: k.isin(_KNOWN))
    entry = lambda k: F.filter(F.json_object_keys(F.call_function("get_json_object", payload, F.concat(F.lit("$."), k, F.lit("[0]")))), lambda f: f.isin(_ENTRY))
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("{"), F.coalesce(F.array_join(F.array_sort(entry(k)), ","), F.lit("")), F.lit("}"))), ",")


def fingerprint(paths: str) -> int:
    """XXH64 (seed 42) of the field paths as a long, which Spark's ``xxhash64`` gives of a column of them."""
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(paths.encode(), 42)))[0]


#: Layout and mapping by fingerprint.
_BY_PRINT = {fingerprint(paths): (name, spec) for name, (paths, spec) in MAPPINGS.items()}


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for name, canonical in ROLES.items():
        out = F.when(role == name, canonical).otherwise(out)
    return out


def _turns(spec: tuple, field, entries) -> Column:
    if spec[0] == "list":
        return F.transform(entries(spec), lambda m: F.struct(_role(m[spec[2]]).alias("role"), F.coalesce(m[spec[3]], F.lit("")).alias("text")))
    asked = [F.when(field(f) != "", field(f)) for f in spec[1]]
    return F.array(F.struct(F.lit("user").alias("role"), F.concat_ws("\n", *asked).alias("text")), F.struct(F.lit("assistant").alias("role"), F.coalesce(field(spec[2]), F.lit("")).alias("text")))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``conv_id, turn, role, text``, one row per turn, of a table whose schema's fingerprint names a mapping.

    Other columns are ignored; a schema without a mapping is an error; null lists have no turns, null roles and texts are '';
    repeated rows are turns of their own; an empty table gives an empty result.
    """
    paths = schema_paths(df.schema)
    if (found := _BY_PRINT.get(fingerprint(paths))) is None:
        raise ValueError(f"no mapping for fields {paths!r}")
    spec, key = found[1], F.col(id_col).alias("conv_id")
    if spec[0] == "rows":
        return df.select(key, F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    made = _turns(spec, lambda f: df[f].cast("string"), lambda s: df[s[1]])
    return df.select(key, F.posexplode(made).alias("turn", "t")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text")


def json_turns(df: DataFrame, id_col: str = "conv_id", payload_col: str = "payload") -> DataFrame:
    """``conv_id, turn, role, text, layout`` of JSON objects of any mix of layouts.

    Fields that no mapping knows are ignored. An object without a mapping, or with an empty list, is one row without a turn, the
    former with a null layout too, so that none is lost unseen. Repeated rows are objects of their own; an empty table gives an empty result.
    """
    payload = F.col(payload_col)
    print_ = F.xxhash64(json_paths(payload))
    turns, layout = F.lit(None).cast(_TURNS), F.lit(None).cast("string")
    for key, (name, spec) in _BY_PRINT.items():
        if spec[0] == "rows":
            continue
        entries = lambda s: F.from_json(F.get_json_object(payload, f"$.{s[1]}"), f"array<struct<`{s[2]}`:string,`{s[3]}`:string>>")
        made = _turns(spec, lambda f: F.get_json_object(payload, f"$.{f}"), entries)
        turns = F.when(print_ == key, made).otherwise(turns)
        layout = F.when(print_ == key, F.lit(name)).otherwise(layout)
    exploded = df.select(F.col(id_col).alias("conv_id"), layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "t"))
    return exploded.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text", "layout")


def escape(text: Column, role: bool = False) -> Column:
    """No ``<`` stays, so no text holds a control string: ``\\`` becomes ``\\\\``, ``<`` ``\\l``, in roles a line end ``\\n``."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\", -1)  # doubled backslashes, from the left
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss``: each conversation's text, and the spans of it that are trained on, as ``start, length``.

    Turns are in the order of ``turn`` (null first), ties of role and text; a turn is ``<turn>``, role, line end, text, ``</turn>``,
    line end. The loss mask covers the escaped text, and nothing else, of turns by the assistant. Repeated rows are turns of
    their own; null roles and texts are ''; a null ``conv_id`` is a conversation; an empty table gives an empty result; other
    columns are ignored. A conversation is one row by its nature; only its formatted turns are gathered for it.
    """
    whole = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n"))
    made = whole.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    place = made.withColumn("nth", F.row_number().over(order)).withColumn("start", F.sum(size.cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size + F.length("head"))
    piece = F.struct("nth", "start", (F.col("role") == "assistant").alias("trained"), F.concat("head", "body", F.lit(CLOSE)).alias("text"), F.length("body").cast("bigint").alias("length"))
    grouped = place.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["trained"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return grouped.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, ``array<struct<role,text>>``: the inverse of the template. '' has none, null is null."""
    chunks = F.split(formatted, OPEN, -1)
    chunks = F.slice(chunks, 2, F.size(chunks))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(chunks, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts hold, read back from them, and of what their loss masks cut out of them.

    One row for each row of ``formatted``; a null text or mask gives null digests; an empty table gives an empty result.
    """
    turns = formatted.select("conv_id", "formatted", "loss", parse(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    out = turns.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), whole.alias("whole"), trained.alias("trained"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2(F.col("whole"), 256).alias("turns_sha256"), F.length("trained").cast("bigint").alias("loss_chars"), F.sha2(F.col("trained"), 256).alias("loss_sha256"), "formatted_chars")
