"""Decisions that people made about records, laid over what was uploaded: a pure function of both."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriate.operators.code import arrow_map
from seriate.operators.reading import arrow_schema

EDITABLE = ("a", "z", "x")
MOST_PARTS = 12


def edited(statements: DataFrame, edits: DataFrame) -> DataFrame:
    """Statements (record_index, field_index, text, z, x) with edits (record_index, field_index, code, value).

    An empty value takes the subfield away; a statement without a text goes. edited: whether anything changed.
    """
    wide = edits.where(F.col("code").isin(*EDITABLE)).groupBy("record_index", "field_index").agg(*[F.max(F.when(F.col("code") == c, F.coalesce("value", F.lit("")))).alias(f"new_{c}") for c in EDITABLE])
    rows = statements.join(wide, ["record_index", "field_index"], "left")
    new = {"text": "new_a", "z": "new_z", "x": "new_x"}
    out = rows.withColumn("edited", F.coalesce(*[F.col(n).isNotNull() & ~F.col(n).eqNullSafe(F.coalesce(F.col(c), F.lit(""))) for c, n in new.items()][:1], F.lit(False)) | F.coalesce(F.col("new_z"), F.col("new_x")).isNotNull())
    for c, n in new.items():
        out = out.withColumn(c, F.nullif(F.trim(F.coalesce(n, c)), F.lit("")))
    return out.drop(*new.values()).where("text IS NOT NULL")


def split(statements: DataFrame, splits: DataFrame) -> DataFrame:
    """Statements divided in place (splits: record_index, field_index, parts); split_part counts from 0, null if whole."""
    rows = statements.join(splits.where(f"size(parts) BETWEEN 2 AND {MOST_PARTS}"), ["record_index", "field_index"], "left")
    parts = F.when(F.col("parts").isNull(), F.array("text")).otherwise(F.col("parts"))
    whole = F.col("parts").isNull().alias("whole")
    out = rows.select("*", whole, F.posexplode(parts).alias("part", "piece"))
    return out.withColumn("text", F.trim("piece")).withColumn("split_part", F.when(~F.col("whole"), F.col("part"))).drop("parts", "part", "piece", "whole")


def same_statement(statements: DataFrame, record_index: int, field_index: int) -> DataFrame:
    """Statements of other records with the same text: an edit can be carried to them."""
    one = statements.where((F.col("record_index") == record_index) & (F.col("field_index") == field_index)).select("text").limit(1)
    return statements.join(one, "text").where(F.col("record_index") != record_index)


def origins(statements: DataFrame) -> DataFrame:
    """Of each text: where it comes first, how often, and how many records have it."""
    return statements.groupBy("text").agg(F.min(F.struct("record_index", "field_index")).alias("first"), F.count("*").alias("times"), F.countDistinct("record_index").alias("records"))


def settings(records: DataFrame, own: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Record settings over file settings: a value that is set counts even if it is empty."""
    rows = records.join(own, "record_index", "left")
    return rows.select("record_index", *[F.when(F.coalesce(F.col(f"{k}_set"), F.lit(False)), F.col(k)).otherwise(F.lit(v)).alias(k) for k, v in defaults.items()])


def under_policy(converted: DataFrame, policy: str = "convert") -> DataFrame:
    """hold: statements to be held because they would lose something: none, themselves, or all of their record."""
    loses = F.exists("warnings", lambda w: w["kind"].startswith("left_out"))
    if policy == "convert":
        return converted.withColumn("hold", F.lit(False))
    if policy == "statement":
        return converted.withColumn("hold", loses)
    bad = converted.where(loses).select("record_index").distinct().withColumn("hold", F.lit(True))
    return converted.join(bad, "record_index", "left").withColumn("hold", F.coalesce("hold", F.lit(False)))


# ---- over records -----------------------------------------------------------------------------------------


def _put(field: dict, code: str, value: str) -> dict:
    """The field with the first subfield of this code set, added, or taken away if the value is empty."""
    subs, at = list(field["subfields"]), next((i for i, s in enumerate(field["subfields"]) if s["code"] == code), None)
    if at is not None:
        subs[at : at + 1] = [{"code": code, "value": value}] if value else []
    elif value:
        subs.append({"code": code, "value": value})
    return field | {"subfields": subs}


def changed(fields: list[dict], edits: list[dict], splits: list[dict]) -> list[tuple[dict, int | None]]:
    """The fields with edits and splits of 866s, each with the place of the 866 that it is a part of, or None."""
    values = {(e["field_index"], e["code"]): (e["value"] or "").strip() for e in edits or []}
    parts, out = {s["field_index"]: s["parts"] for s in splits or []}, []
    for i, f in enumerate(fields):
        if f["tag"] != "866":
            out.append((f, None))
            continue
        for code in EDITABLE:
            if (i, code) in values:
                f = _put(f, code, values[i, code])
        if i in parts:
            out += [(_put(f, "a", x.strip()), i) for x in parts[i]]
        elif f["subfields"]:  # an 866 that nothing is left of goes
            out.append((f, None))
    return [(f | {"pos": n}, of) for n, (f, of) in enumerate(out)]


def _changer(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [changed(f, e, s) for f, e, s in zip(*(b[c].to_pylist() for c in ("fields", "edits__", "splits__")), strict=True)]
            new = {"fields": pa.array([[f for f, _ in x] for x in made], schema.field("fields").type), "split_of": pa.array([[of for _, of in x] for x in made], pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b[n] for n in schema.names], schema=schema)

    return run


def edited_records(records: DataFrame, edits: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Records with edits (record_index, field_index, code, value) and splits (record_index, field_index, parts) of 866s.

    split_of: for each field, the place in the upload of the 866 that it is a part of, or null; null for records that
    nobody changed, which pass untouched. Edits of other fields and codes are left aside; of several values for one
    subfield the greatest counts; a split takes the place of an edit of the same text.
    """
    none = F.lit(None).cast("array<int>").alias("split_of")
    if edits is None and splits is None:
        return records.select("*", none)
    parts = []
    if edits is not None:
        one = edits.where(F.col("code").isin(*EDITABLE)).groupBy("record_index", F.col("field_index").cast("int").alias("field_index"), "code").agg(F.max(F.coalesce("value", F.lit(""))).alias("value"))
        parts.append(one.groupBy("record_index").agg(F.collect_list(F.struct("field_index", "code", "value")).alias("edits__")))
    if splits is not None:
        whole = splits.where(f"size(parts) BETWEEN 2 AND {MOST_PARTS}").groupBy("record_index", F.col("field_index").cast("int").alias("field_index")).agg(F.max("parts").alias("parts"))
        parts.append(whole.groupBy("record_index").agg(F.collect_list(F.struct("field_index", "parts")).alias("splits__")))
    each = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "record_index", "full")
    for name, kind in (("edits__", "array<struct<field_index: int, code: string, value: string>>"), ("splits__", "array<struct<field_index: int, parts: array<string>>>")):
        if name not in each.columns:
            each = each.withColumn(name, F.lit(None).cast(kind))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema.fields) + ", split_of array<int>"
    touched = arrow_map(records.join(each, "record_index"), _changer(arrow_schema(ddl)), ddl)
    return records.join(each.select("record_index"), "record_index", "left_anti").select(*records.columns, none).unionByName(touched)


def edit_notes(edits: DataFrame, before: DataFrame) -> DataFrame:
    """record_index, note: a sentence for each edit (record_index, field_index, code, value) of statements (record_index, field_index, text, z, x)."""
    rows = edits.where(F.col("code").isin(*EDITABLE)).join(before.select("record_index", "field_index", "text", "z", "x"), ["record_index", "field_index"], "left")
    old = F.coalesce(F.when(F.col("code") == "a", F.col("text")).when(F.col("code") == "z", F.col("z")).otherwise(F.col("x")), F.lit(""))
    new = F.trim(F.coalesce("value", F.lit("")))
    what = F.when(F.col("code") == "a", "the statement").when(F.col("code") == "z", "the public note").otherwise("the staff note")
    said = F.when(new == "", F.concat(F.lit("took away "), what, F.lit(": "), old)).when(old == "", F.concat(F.lit("added "), what, F.lit(": "), new)).otherwise(F.concat(F.lit("changed "), what, F.lit(" from "), old, F.lit(" to "), new))
    return rows.where(old != new).select("record_index", "field_index", said.alias("note"))


def matched(statements: DataFrame, given: DataFrame) -> DataFrame:
    """Texts as they come back from a person (record_index, nth, text) with the 866 that each stands for (field_index).

    Each 866 is claimed once: the second of two equal texts stands for the second 866 that holds it. A text that no 866
    holds, as it was changed, stands for none, and no field may be removed on its account.
    """
    order = lambda by: F.row_number().over(Window.partitionBy("record_index", "text").orderBy(by))
    own = statements.select("record_index", F.trim("text").alias("text"), "field_index").withColumn("time", order("field_index"))
    back = given.select("record_index", "nth", F.trim("text").alias("text")).withColumn("time", order("nth"))
    return back.join(own, ["record_index", "text", "time"], "left").select("record_index", "nth", "text", "field_index")


def records_with(statements: DataFrame) -> DataFrame:
    """text, record_index: the records that hold each text, one row for each, however many there are."""
    return statements.select("text", "record_index").distinct()
