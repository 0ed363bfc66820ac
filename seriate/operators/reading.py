"""Reading statements at scale: each distinct text is read once, then joined back.

The grammar runs as an Arrow-batched function; everything around it is native. A text that a third of all rows
share is read once, and the join back can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seriate.functions import fields, grammar
from seriate.functions.schemas import CONVERTED, PARSED
from seriate.operators.code import arrow_map, spread

#: Statement outcomes, the first that holds.
OUTCOMES = ("elsewhere", "unread", "held", "to_check", "left_out", "noted", "clean")


@lru_cache(maxsize=64)
def arrow_schema(ddl: str) -> pa.Schema:
    """On the driver only: executors can't parse DDL."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def table_of(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _plain_boundary(b: dict | None) -> dict | None:
    return b and b | {"enum": [{"caption": c, "value": v} for c, v in b["enum"]], "shown": sorted(b["shown"])}


def to_row(parsed: dict) -> dict:
    """A reading with Arrow's types only."""
    return parsed | {"ranges": [r | {"start": _plain_boundary(r["start"]), "end": _plain_boundary(r["end"])} for r in parsed["ranges"]]}


def _field(f: dict | None) -> dict | None:
    return f and {**f, "subfields": [{"code": c, "value": v} for c, v in f["subfields"]]}


def converted_row(c: dict) -> dict:
    return {k: c[k] for k in ("link", "conformed", "held", "flagged", "belongs_in", "switch", "warnings", "attention", "left_out")} | {"field_853": _field(c["field_853"]), "fields_863": [_field(f) for f in c["fields_863"]]}


def _reader(options: dict):
    ddl = f"text string, parsed {PARSED}, converted struct<{', '.join(_as_struct(CONVERTED))}>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                parsed = grammar.read(text)
                rows.append({"text": text, "parsed": to_row(parsed), "converted": converted_row(fields.convert(parsed, **options))})
            yield from table_of(rows, schema).to_batches()

    return run, ddl


def reader_of(library: list | None, fallback: str = "parser"):
    """text -> (source, reading): by the grammar alone, or by patterns first."""
    if library is None and fallback == "parser":
        return lambda text: ("parser", grammar.read(text))
    from seriate.operators.patterns import read_by  # patterns need this module

    return lambda text: read_by(text, library or [], fallback)


def _as_struct(ddl: str) -> list[str]:
    """Columns of a DDL as members of a struct."""
    return [f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields]


def read_texts(texts: DataFrame, **options) -> DataFrame:
    """text, parsed, converted of each distinct text."""
    run, ddl = _reader(options)
    return arrow_map(spread(texts.select(F.col("text").cast("string").alias("text")).distinct(), "text"), run, ddl)


def read_statements(statements: DataFrame, **options) -> DataFrame:
    """The statements with what was read of each, and its fields as if it stood alone."""
    return statements.join(read_texts(statements.where("text IS NOT NULL"), **options), "text", "left")


def outcome(parsed: Column, converted: Column) -> Column:
    """One of OUTCOMES."""
    kinds = F.transform(converted["warnings"], lambda w: w["kind"])
    return (
        F.when(parsed["belongs_in"].isNotNull(), "elsewhere")
        .when(~parsed["success"], "unread")
        .when(converted["held"], "held")
        .when(F.array_contains(kinds, "left_out_to_check") | converted["flagged"], "to_check")
        .when(F.array_contains(kinds, "left_out"), "left_out")
        .when(F.size(kinds) > 0, "noted")
        .otherwise("clean")
    )


def elsewhere(text: Column) -> Column:
    """868 or 867 for an index or a supplement, by the words outside brace notes; null for holdings. As grammar.read has it."""
    plain = F.regexp_replace(text, r"\{[^{}]*\}?", " ")
    return F.when(plain.rlike(f"(?i){grammar.INDEX.pattern}"), "868").when(plain.rlike(f"(?i){grammar.SUPPLEMENT.pattern}"), "867")


def display(field: Column) -> Column:
    """853 31 $8 1 $a v., natively."""
    ind = F.transform(F.array(field["ind1"], field["ind2"]), lambda i: F.when(F.coalesce(F.trim(i), F.lit("")) == "", "#").otherwise(i))
    subs = F.array_join(F.transform(field["subfields"], lambda s: F.concat(F.lit("$"), s["code"], F.lit(" "), F.trim(s["value"]))), " ")
    return F.concat_ws(" ", field["tag"], F.array_join(ind, ""), subs)
