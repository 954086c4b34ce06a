"""Chat formatting by schema fingerprint.

The nested field paths of a record that mappings know are hashed; each hash seen selects a declarative mapping to
canonical turns ``array<struct<role, text>>``. Turns are then rendered with a template whose marks cannot occur in a
text, because ``&``, ``<`` and ``>`` of roles and texts are escaped as entities, which is reversible.

Null texts and roles are empty strings. Rows of a conversation are ordered by turn, ties by role and text; repeated rows
are turns of their own. Role names of other layouts than rows are brought to ``user`` and ``assistant``; rows keep theirs. Rows without a conversation id form one conversation with a null id. A record without
turns gives an empty formatted text. Unknown layouts raise (tables) or give null turns (JSON records). Further columns
are ignored, as only the mapped paths are part of a fingerprint.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Mapping:
    """``turns``: for a list layout the path of the list and its role and text fields; else (role, path) pairs."""

    name: str
    paths: tuple[str, ...]
    list_path: str | None = None
    role: str | None = None
    text: str | None = None
    turns: tuple[tuple[str, str], ...] = ()


# The layouts that occur, most specific first.
LAYOUTS = (
    Mapping("rows", ("conv_id", "role", "text", "turn")),
    Mapping("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("shared_turns", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping("turn_list", ("turns[].role", "turns[].text"), "turns", "role", "text"),
    Mapping("instruction_input", ("input", "instruction", "output"), turns=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt_system", ("prompt", "response", "system"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
)
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN_PATHS = sorted({p for m in LAYOUTS for p in m.paths})


def fingerprint(paths) -> str:
    """SHA-256 of the sorted field paths of a layout."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


# Layouts with more paths first among those that are told by lists or rows, and then the flat ones: a record has the first whose paths it holds.
RANKED = sorted(LAYOUTS, key=lambda m: (m.turns != (), -len(m.paths)))
MOST_PRINTS = 10_000


def mappings(seen: dict[str, list[str]]) -> dict[str, Mapping]:
    """The mapping of each fingerprint, given with the known paths that it was made from; those of no layout have none."""
    found = {key: next((m for m in RANKED if set(paths).issuperset(m.paths)), None) for key, paths in seen.items()}
    return {key: m for key, m in found.items() if m}


def mapping_of(paths) -> Mapping | None:
    """The mapping of the fingerprint of a record's known paths; its further fields are not hashed."""
    known = sorted(set(paths).intersection(KNOWN_PATHS))
    return mappings({fingerprint(known): known}).get(fingerprint(known))


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def _turn(role: Column, text: Column, rename: bool = True) -> Column:
    named = F.coalesce(role.cast("string"), F.lit(""))
    for other, name in ROLE_NAMES.items() if rename else ():
        named = F.when(role == other, name).otherwise(named)
    return F.struct(named.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def canonical_turns(records: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """``id, turns`` of a table in any known layout; row layouts are grouped by conversation."""
    found = mapping_of(field_paths(records.schema))
    if found is None:
        raise ValueError(f"no mapping for the field paths {field_paths(records.schema)}")
    if found.name == "rows":
        row = F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        )
        grouped = records.groupBy(F.col("conv_id").alias(id_column)).agg(F.array_sort(F.collect_list(row)).alias("t"))
        return grouped.select(id_column, F.transform("t", lambda t: _turn(t["role"], t["text"], rename=False)).alias("turns"))
    if found.list_path:
        items = F.coalesce(F.col(found.list_path), F.array().cast(records.schema[found.list_path].dataType))
        turns = F.transform(items, lambda t: _turn(t[found.role], t[found.text]))
    else:
        turns = F.array(*(_turn(F.lit(role), F.col(path)) for role, path in found.turns))
    return records.select(id_column, turns.alias("turns"))


def canonical_turns_json(records: DataFrame, json_column: str, id_column: str = "conv_id") -> DataFrame:
    """``id, layout, turns`` of JSON records that may each have another layout."""
    value = F.try_parse_json(json_column)

    df = records.select(id_column, value.alias("v"))

    def held(path: str) -> Column:
        if "[]" not in path:
            return F.try_variant_get("v", f"$.{path}", "variant").isNotNull()
        at, field = path.split("[].")
        items = F.try_variant_get("v", f"$.{at}", "array<variant>")
        # An empty list has no fields, but tells its layout.
        return (F.size(items) == 0) | F.exists(items, lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull())

    paths = F.array_compact(F.array(*(F.when(held(p), p) for p in KNOWN_PATHS)))
    df = df.withColumn("paths", paths).withColumn("print", F.sha2(F.array_join("paths", "\n").cast("binary"), 256))
    # Fingerprints of known paths are few; each one seen gets its mapping.
    seen = df.select("print", "paths").distinct().limit(MOST_PRINTS + 1).collect()
    if len(seen) > MOST_PRINTS:
        raise ValueError(f"more than {MOST_PRINTS} layouts")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for key, m in mappings({r["print"]: r["paths"] for r in seen}).items():
        if m.list_path:
            kind = f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
            role, text = m.role, m.text
            made = F.transform(F.try_variant_get("v", f"$.{m.list_path}", kind), lambda t: _turn(t[role], t[text]))
        elif m.turns:
            made = F.array(*(_turn(F.lit(r), F.try_variant_get("v", f"$.{p}", "string")) for r, p in m.turns))
        else:
            continue
        layout = F.when(F.col("print") == key, m.name).otherwise(layout)
        turns = F.when(F.col("print") == key, made).otherwise(turns)
    return df.select(id_column, layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def format_chats(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """``id, formatted, loss_mask``: the mask holds the code point spans of the assistant's escaped texts."""
    parts = turns.select(
        id_column,
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit("<turn:"), escape(t["role"]), F.lit(">")).alias("head"),
                escape(t["text"]).alias("body"),
                (t["role"] == "assistant").alias("loss"),
            ),
        ).alias("parts"),
    )
    zero = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")
    )

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(
            (end + F.lit(len("</turn>"))).alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return parts.select(
        id_column,
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("</turn>"))), "").alias("formatted"),
        F.aggregate("parts", zero, step)["spans"].alias("loss_mask"),
    )


def read_back(formatted: DataFrame, id_column: str = "conv_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, *keep, turns, loss_texts``, parsed from the formatted text and its mask alone."""
    pieces = F.filter(F.split("formatted", "</turn>"), lambda p: p != "")
    return formatted.select(
        id_column,
        *keep,
        F.transform(
            pieces,
            lambda p: F.struct(
                unescape(F.replace(F.substring_index(p, ">", 1), F.lit("<turn:"), F.lit(""))).alias("role"),
                unescape(F.substr(p, F.instr(p, ">") + 1)).alias("text"),
            ),
        ).alias("turns"),
        F.transform(
            "loss_mask",
            lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))),
        ).alias("loss_texts"),
    )


ORACLE = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')) v(a, b, c, d)),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(esc) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
