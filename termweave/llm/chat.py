"""Chat formatting: records of different layouts become canonical turns, and those one string.

A record's layout is known by its fingerprint: a hash of its nested field paths. A
declared mapping for that fingerprint says where roles and texts are. Only DataFrame
functions are used.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What opens every control string; escaped wherever it stands in a role or text.
OPENING = "<|"
TURNS = "array<struct<role: string, text: string>>"
#: Role names of other layouts (fixed values).
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of all leaves; `[]` stands for the elements of a list."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of field paths, whatever their order."""
    return hashlib.md5("\n".join(sorted(set(paths))).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """A layout, by its field paths, and the canonical turns as an expression over a record (a struct column)."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Column], Column]

    @property
    def fingerprint(self) -> str:
        return fingerprint(list(self.paths))


def _turn(role, text) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _renamed(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(names[role], role)


def _listed(record: Column, field: str, role: str, text: str) -> Column:
    return F.transform(F.coalesce(record[field], F.array()), lambda t: _turn(_renamed(t[role]), t[text]))


def _ordered(record: Column) -> Column:
    rows = F.transform(record["rows"], lambda t: F.struct(t["turn"].alias("turn"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return F.transform(F.array_sort(rows), lambda t: _turn(t["role"], t["text"]))


def _pair(user: Column, assistant: Column) -> Column:
    return F.array(_turn(F.lit("user"), user), _turn(F.lit("assistant"), assistant))


def _instruction(record: Column) -> Column:
    extra = F.coalesce(record["input"], F.lit(""))
    asked = F.coalesce(record["instruction"], F.lit(""))
    return _pair(F.when(extra == "", asked).otherwise(F.concat(asked, F.lit("\n\n"), extra)), record["output"])


#: Layouts known by default.
MAPPINGS = (
    Mapping("turn rows", ("rows[].role", "rows[].text", "rows[].turn"), _ordered),
    Mapping("messages", ("messages[].content", "messages[].role"), lambda r: _listed(r, "messages", "role", "content")),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), lambda r: _listed(r, "conversations", "from", "value")),
    Mapping("prompt and completion", ("completion", "prompt"), lambda r: _pair(r["prompt"], r["completion"])),
    Mapping("prompt and response", ("prompt", "response"), lambda r: _pair(r["prompt"], r["response"])),
    Mapping("instruction", ("input", "instruction", "output"), _instruction),
    Mapping("instruction without input", ("instruction", "output"), lambda r: _pair(r["instruction"], r["output"])),
)
#: The JSON layouts' Spark types, read with `from_json`.
JSON_TYPES = {
    "messages": "messages array<struct<role: string, content: string>>",
    "from and value": "conversations array<struct<`from`: string, value: string>>",
    "prompt and completion": "prompt string, completion string",
    "prompt and response": "prompt string, response string",
    "instruction": "instruction string, `input` string, output string",
    "instruction without input": "instruction string, output string",
}


def rows_to_records(rows: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`(key, record)`: one struct record of layout "turn rows" for each conversation; rows without a key are one conversation.

    A conversation becomes one row, as its format is one string; the number of its turns is what bounds a task.
    """
    row = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.groupBy(key).agg(F.struct(F.collect_list(row).alias("rows")).alias("record"))


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds `layout` and `turns` (role, text) to rows with a struct column `record`.

    The struct's own field paths make the fingerprint; an unknown one raises. Missing
    roles and texts are empty; a null record has no turns. Turns of layout "turn rows"
    are ordered by turn (nulls last), then role and text.
    """
    known = {m.fingerprint: m for m in mappings}
    paths = field_paths(records.schema[record].dataType)
    found = known.get(fingerprint(paths))
    if found is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    turns = F.when(F.col(record).isNotNull(), found.turns(F.col(record))).otherwise(F.array().cast(TURNS))
    return records.withColumn("layout", F.lit(found.name)).withColumn("turns", turns)


def canonical_json(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds `fingerprint`, `layout` and `turns` to rows whose `record` is a JSON text, each of any known layout.

    The fingerprint is taken from each text's own schema. A record with more fields than
    any mapping has is read by the mapping with the most paths that are all in the record
    (ties: the first listed). Texts that are null, no JSON or hold no mapping's paths have
    a null layout and no turns; `rejects` gives them.
    """
    schema = F.schema_of_variant(F.try_parse_json(F.col(record)))
    # `OBJECT<a: STRING, b: ARRAY<OBJECT<c: STRING>>>`: scalar types (or null) are left out, names and nesting stay.
    shape = F.regexp_replace(F.regexp_replace(schema, r": (?!ARRAY<|OBJECT<)[A-Z]+(\([0-9, ]*\))?", ""), r"\s", "")
    out = records.withColumn("fingerprint", F.md5(shape))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for mapping in mappings:
        if mapping.name in JSON_TYPES:
            fits = F.col("fingerprint").isin([hashlib.md5(s.encode()).hexdigest() for s in _shapes(mapping.paths)])
            layout = F.when(fits, F.lit(mapping.name)).otherwise(layout)
            turns = F.when(fits, mapping.turns(F.from_json(record, JSON_TYPES[mapping.name]))).otherwise(turns)
    fields = F.from_json(record, "map<string, string>")
    out = out.withColumn("_exact", layout).withColumn("_fields", F.when(F.col("_exact").isNull(), fields))
    layout = F.col("_exact")
    for mapping in sorted((m for m in mappings if m.name in JSON_TYPES), key=lambda m: -len(m.paths)):
        held = layout.isNull() & _holds(F.col("_fields"), mapping.paths)
        turns = F.when(held, mapping.turns(F.from_json(record, JSON_TYPES[mapping.name]))).otherwise(turns)
        layout = F.when(held, F.lit(mapping.name)).otherwise(layout)
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("_exact", "_fields")


def rejects(canonical: DataFrame) -> DataFrame:
    """The rows of `canonical_json` that no mapping fits."""
    return canonical.where("layout IS NULL")


def _has_key(name: str) -> Callable[[Column], Column]:
    return lambda record: F.coalesce(F.map_contains_key(record, name), F.lit(False))


def _holds(fields: Column, paths: tuple[str, ...]) -> Column:
    """Whether a record, as a map from its fields to their JSON texts, has all the paths; a list of records may also be empty."""
    tests = []
    for path in paths:
        name, _, inner = path.partition("[].")
        test = F.map_contains_key(fields, name)
        if inner:
            parts = F.from_json(fields[name], "array<map<string, string>>")
            test = (F.size(parts) == 0) | F.exists(parts, _has_key(inner))
        tests.append(F.coalesce(test, F.lit(False)))
    return functools.reduce(lambda a, b: a & b, tests)


def _shapes(paths: tuple[str, ...]) -> list[str]:
    """A layout as the schema text writes it, with fields in alphabetical order; a list of records may also be empty."""
    lists = sorted({p.split("[].")[0] for p in paths if "[]." in p})
    if not lists:
        return [f"OBJECT<{','.join(sorted(paths))}>"]
    inner = ",".join(sorted(p.split("[].")[1] for p in paths))
    return [f"OBJECT<{lists[0]}:ARRAY<OBJECT<{inner}>>>", f"OBJECT<{lists[0]}:ARRAY<VOID>>"]


def escaped(text: Column) -> Column:
    """Reversible: no control string is left in the text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(OPENING), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(records: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """Adds `formatted` and `loss_spans`, (start, length) in code points of the texts of `trained` turns.

    Each turn is `<|im_start|>role<|im_sep|>text<|im_end|>` and a line end, with
    backslashes and `<|` of role and text escaped. Null turns count as none.
    """
    rows = F.transform(
        F.coalesce(turns, F.array().cast(TURNS)), lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"), (t["role"] == trained).alias("trained"))
    )
    pieces = F.transform("_rows", lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END + "\n")))
    head, rest = len(START) + len(MIDDLE), len(END) + 1
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, length: long>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + head + F.char_length(t["role"])
        size = F.char_length(t["text"]).cast("long")
        more = F.when(t["trained"], F.concat(state["spans"], F.array(F.struct(start.alias("start"), size.alias("length"))))).otherwise(state["spans"])
        return F.struct((start + size + rest).alias("at"), more.alias("spans"))

    out = records.withColumn("_rows", rows).withColumn("formatted", F.array_join(pieces, ""))
    return out.withColumn("loss_spans", F.aggregate("_rows", empty, step, lambda s: s["spans"])).drop("_rows")


def read_back(formatted: str = "formatted") -> Column:
    """Canonical turns out of a formatted string."""
    whole = F.split(F.col(formatted), r"\Q" + END + "\n" + r"\E")
    parts = F.filter(whole, lambda p: F.startswith(p, F.lit(START)))
    middle = lambda p: F.instr(p, MIDDLE)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring(p, F.lit(len(START) + 1), middle(p) - 1 - len(START))).alias("role"), unescaped(F.substring(p, middle(p) + len(MIDDLE), F.char_length(p))).alias("text")
        ),
    )


def masked_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped."""
    cut = F.transform(spans, lambda s: unescaped(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")
