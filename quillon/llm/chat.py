"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record's layout is the set of its nested field paths down to single values (``messages[].content[].text``). Of these the paths that a
mapping names are hashed, row by row; where the hash is the mapping's own fingerprint, that mapping is selected, the one with the
most paths first, so further keys don't hide a layout. Mappings are declarative: they say where the turns lie, and turns are made
canonical: (role, text) in order. Records are JSON texts or typed columns, of which each row fills those of its layout.
Formatted, a turn is ``<turn ROLE>TEXT</turn>``.  Inside roles and texts every ``\\`` is written ``\\e`` and every ``<`` ``\\l``
(in roles also ``>`` as ``\\g``), so that control strings occur only as marks and the output can be read back exactly.

Defined results: null text and role count as empty; turns go by (turn, role, text), nulls first, so ties and repeated rows have one order
and all stay; rows without a conv_id belong to nobody, so each is a conversation of its own; an empty table gives no conversations; a
layout of no mapping, a null record and text that isn't JSON (or is beyond the size of a variant) give no turns and the mapping
``unknown``; a conversation is one value, so it is held whole however long it is, and no two are held together; other columns are
ignored, whatever their names, and kept by ``canonical_json`` and ``canonical_typed``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table

#: Names that roles have in different layouts.
ROLES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "model": "assistant", "system": "system"}


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout lie: either ``turns`` names an array with its role and text fields (a text may be a list of parts
    with ``part`` as their text field), or ``fixed`` lists (role, fields), whose texts are joined by blank lines where they aren't empty."""

    name: str
    turns: tuple[str, str, str] | None = None
    part: str | None = None
    plain: bool = True
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        if not self.turns:
            return tuple(n for _, names in self.fixed for n in names)
        array, role, text = self.turns
        return (f"{array}[].{role}", *([f"{array}[].{text}"] if self.plain else []), *([f"{array}[].{text}[].{self.part}"] if self.part else []))


MAPPINGS = (
    Mapping("mixed messages", turns=("messages", "role", "content"), part="text"),
    Mapping("messages", turns=("messages", "role", "content")),
    Mapping("message parts", turns=("messages", "role", "content"), part="text", plain=False),
    Mapping("message texts", turns=("messages", "role", "text")),
    Mapping("conversations", turns=("conversations", "from", "value")),
    Mapping("instruction", fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system prompt", fixed=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",)))),
    Mapping("instruction only", fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("prompt", fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)

TURNS = "array<struct<role: string, text: string>>"


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def nested(value: Column, steps: list[str], found: Callable[[Column], Column]) -> Column:
    """``found`` of what lies in a variant below keys and, for ``[]``, of any element."""
    if not steps:
        return found(value)
    if steps[0] == "[]":
        return F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(nested(x, steps[1:], found), F.lit(False)))
    return nested(F.try_variant_get(value, f"$.{steps[0]}", "variant"), steps[1:], found)


def split_path(path: str) -> list[str]:
    return [s for key in path.split(".") for s in ([key[:-2], "[]"] if key.endswith("[]") else [key])]


def single(value: Column) -> Column:
    """Whether a variant is a single value, null included, and neither missing nor an array or object."""
    return F.coalesce(~F.schema_of_variant(value).rlike("^(ARRAY|OBJECT)<"), F.lit(False))


def layout(raw: Column) -> Column:
    """The whole nested layout of a JSON text, to full depth, without the types of its values; null where it isn't JSON."""
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(raw)), r"(BIGINT|BOOLEAN|STRING|DOUBLE|VOID|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "VALUE")


def present(named: dict[str, Column]) -> Column:
    """The names of the paths that a row has."""
    return F.filter(F.array(*[F.when(F.coalesce(has, F.lit(False)), F.lit(path)) for path, has in named.items()]), lambda p: p.isNotNull())


def selected(paths: Column, mappings: tuple[Mapping, ...], made: Callable[[Mapping], Column]) -> tuple[Column, Column]:
    """(name, turns) by the fingerprint that the row's paths give among each mapping's own."""
    turns, name = F.lit(None).cast(TURNS), F.lit("unknown")
    for m in sorted(mappings, key=lambda m: len(m.paths)):  # the last one tried decides
        own = F.array(*map(F.lit, m.paths))
        hit = fingerprint(F.array_intersect(paths, own)) == fingerprint(own)
        turns, name = F.when(hit, made(m)).otherwise(turns), F.when(hit, F.lit(m.name)).otherwise(name)
    return name, F.coalesce(turns, F.array().cast(TURNS))


def unused(records: DataFrame, name: str) -> str:
    while name in records.columns:
        name += "_"
    return name


def canonical_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(role))), role, F.lit(""))


def joined(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != ""), "\n\n")


def fixed_turns(mapping: Mapping, field: Callable[[str], Column]) -> Column:
    made = [F.struct(F.lit(role).alias("role"), joined([field(n) for n in names]).alias("text")) for role, names in mapping.fixed]
    return F.filter(F.array(*made), lambda t: ~((t["role"] == "system") & (t["text"] == "")))


def turns_of_json(value: Column, mapping: Mapping) -> Column:
    text_at = lambda v, key: F.try_variant_get(v, f"$.{key}", "string")
    if not mapping.turns:
        return fixed_turns(mapping, lambda n: text_at(value, n))
    array, role, text = mapping.turns

    def said(message: Column) -> Column:
        if not mapping.part:
            return text_at(message, text)
        parts = F.try_variant_get(message, f"$.{text}", "array<variant>")
        listed = F.array_join(F.transform(parts, lambda p: F.coalesce(text_at(p, mapping.part), F.when(single(p), F.try_variant_get(p, "$", "string")))), "\n")
        return F.when(F.schema_of_variant(F.try_variant_get(message, f"$.{text}", "variant")).startswith("ARRAY<"), listed).otherwise(text_at(message, text))

    each = F.try_variant_get(value, f"$.{array}", "array<variant>")
    return F.transform(each, lambda m: F.struct(canonical_role(text_at(m, role)).alias("role"), F.coalesce(said(m), F.lit("")).alias("text")))


def canonical_json(records: DataFrame, raw: str = "raw", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``mapping`` (its name) and ``turns``: each row's own fingerprint selects its mapping."""
    value, paths = unused(records, "_value"), unused(records, "_paths")
    parsed = records.withColumn(value, F.try_parse_json(F.col(raw)))
    named = {p: nested(F.col(value), split_path(p), single) for m in mappings for p in m.paths}
    name, turns = selected(F.col(paths), mappings, lambda m: turns_of_json(F.col(value), m))
    return parsed.withColumn(paths, present(named)).select(*records.columns, name.alias("mapping"), turns.alias("turns"))


def typed_paths(kind: T.DataType, value: Column, at: str = "") -> dict[str, Column]:
    """Paths of a typed value down to single values, and whether a row has them: none of what is null is there."""
    if isinstance(kind, T.ArrayType):
        inner = lambda p: lambda x: F.coalesce(typed_paths(kind.elementType, x, at + "[]")[p], F.lit(False))
        return {p: F.exists(value, inner(p)) for p in typed_paths(kind.elementType, value, at + "[]")}
    if isinstance(kind, T.StructType):
        return {p: has for f in kind.fields for p, has in typed_paths(f.dataType, value[f.name], f"{at}.{f.name}" if at else f.name).items()}
    return {at: value.isNotNull()}


def canonical_typed(records: DataFrame, columns: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The same for typed columns, of which each row fills those of its layout and leaves the others null; roles stay as they are."""
    found: dict[str, Column] = {}
    for c in columns:
        found |= typed_paths(records.schema[c].dataType, F.col(c), c)
    paths = unused(records, "_paths")
    used = {p: has for p, has in found.items() if any(p in m.paths for m in mappings)}
    able = tuple(m for m in mappings if set(m.paths) <= used.keys())

    def made(m: Mapping) -> Column:
        if not m.turns:
            return fixed_turns(m, F.col)
        array, role, text = m.turns
        said = lambda x: F.array_join(F.transform(x[text], lambda p: p[m.part]), "\n") if m.part else x[text]
        return F.transform(F.col(array), lambda x: F.struct(F.coalesce(x[role], F.lit("")).alias("role"), F.coalesce(said(x), F.lit("")).alias("text")))

    name, turns = selected(F.col(paths), able, made)
    with_paths = records.withColumn(paths, present(used) if used else F.array().cast("array<string>"))
    return with_paths.select(*records.columns, name.alias("mapping"), turns.alias("turns"))


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescape(text: Column) -> Column:
    """Every backslash begins an escape, so the order of replacing matters only in that it comes back last."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\e"), F.lit("\\"))


def render(turns: Column) -> Column:
    each = F.transform(turns, lambda t: F.concat(F.lit("<turn "), escape(t["role"], role=True), F.lit(">"), escape(t["text"]), F.lit("</turn>")))
    return F.array_join(each, "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    parts = F.filter(F.split(formatted, "</turn>"), lambda p: p != "")
    head = lambda p: F.instr(p, ">")
    role = lambda p: unescape(F.substring(p, F.lit(7), head(p) - 7))
    text = lambda p: unescape(F.substring(p, head(p) + 1, F.length(p)))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def loss_spans(formatted: Column) -> Column:
    """Where the loss counts: (start, length) in code points of the escaped texts of assistants."""
    parts = F.filter(F.split(formatted, "</turn>"), lambda p: p != "")
    step = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p) + 7).alias("at"),
            F.when(p.startswith("<turn assistant>"), F.concat(s["spans"], F.array(F.struct((s["at"] + 16).alias("start"), (F.length(p) - 16).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return step["spans"]


def laid_out(ordered: DataFrame) -> DataFrame:
    """Conversations (conv_id, said: turns in order) as records of several layouts: a question and its answer as prompt and response, one
    under a system prompt as system_prompt, question and response, everything else as messages."""
    said = F.col("said")
    roles = F.transform(said, lambda t: t["role"])
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    led = (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (F.get(said, 0)["text"] != "")
    of = lambda n: F.get(said, n)["text"]
    messages = F.transform(said, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return ordered.select(
        "conv_id", F.when(pair, of(0)).alias("prompt"), F.when(led, of(0)).alias("system_prompt"), F.when(led, of(1)).alias("question"),
        F.when(pair, of(1)).when(led, of(2)).alias("response"), F.when(~pair & ~led, messages).alias("messages"),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, mapping, formatted, loss (spans) of rows by turn (conv_id, turn, role, text)."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63)).cast("long")).alias("turn"), "role", "text"))).alias("ordered"))
    ordered = grouped.select("conv_id", F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("said"))
    alone = rows.where("conv_id is null").select("conv_id", F.array(F.struct("role", "text")).alias("said"))
    found = canonical_typed(laid_out(ordered.union(alone)), ["messages", "prompt", "response", "system_prompt", "question"])
    return found.select("conv_id", "mapping", render(F.col("turns")).alias("formatted")).withColumn("loss", loss_spans(F.col("formatted")))


def op4_schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    out = format_conversations(rows)
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return out.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER (PARTITION BY conv_id) END AS n FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 0 UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 0
), sized AS (
  SELECT *, 6 + length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '>', '\g')) + 1 + length(replace(replace(text, '\', '\e'), '<', '\l')) + 7 AS chars FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN n END
"""

QUERIES = {"op4_schema_fingerprints": op4_schema_fingerprints}
ORACLES = {"op4_schema_fingerprints": SQL}
