"""Quality of records and of their conversion: audits, profiles, counts and the log."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriate.functions import fields, grammar, render
from seriate.operators.code import arrow_map, spread
from seriate.operators.records import tagged

# Holdings tags, which say nothing about who a record is, and unremarkable encoding levels.
HOLDINGS_TAGS = ("853", "854", "855", "863", "864", "865", "866", "867", "868")
USUAL_LEVELS = ("m", "u", "z", " ", "")


def identifier_candidates(records: DataFrame, top: int = 6) -> DataFrame:
    """Fields that could identify records: unrepeated, unique, on most records, with many values."""
    f = records.select("record_index", F.explode("fields").alias("f")).where(~F.col("f.tag").isin(*HOLDINGS_TAGS))
    control = f.where("f.tag < '010'").select("record_index", F.col("f.tag").alias("key"), F.trim("f.data").alias("value"))
    coded = f.where("f.tag >= '010'").select("record_index", "f.tag", F.explode("f.subfields").alias("s")).select("record_index", F.concat("tag", F.lit("$"), "s.code").alias("key"), F.trim("s.value").alias("value"))
    each = control.unionByName(coded).where("value <> ''").groupBy("record_index", "key").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    by = each.groupBy("key").agg(F.count("*").alias("present"), F.countDistinct("value").alias("distinct"), F.max("n").alias("repeats"), F.min("value").alias("sample"))
    kept = by.where("distinct >= 2").withColumn("unique", F.col("distinct") == F.col("present"))
    return kept.orderBy(F.col("repeats") > 1, ~F.col("unique"), F.desc("present"), F.desc("distinct"), "key").limit(top)


def existing_853_notes(records: DataFrame) -> DataFrame:
    """Caption fields with an indicator that isn't 0 to 3, and links that two of them share."""
    f = records.select("record_index", F.explode(tagged("853")).alias("f"))
    link = F.get(F.filter("f.subfields", lambda s: s["code"] == "8"), F.lit(0))["value"]
    odd = f.where(~(F.col("f.ind1").rlike("^[0-3]$") & F.col("f.ind2").rlike("^[0-3]$"))).select("record_index", F.concat(F.lit("indicators "), "f.ind1", "f.ind2").alias("note"))
    twice = f.groupBy("record_index", link.alias("link")).count().where("count > 1 AND link IS NOT NULL").select("record_index", F.concat(F.lit("link "), "link", F.lit(" is used twice")).alias("note"))
    return odd.unionByName(twice)


def _coded(f: Column, codes: str) -> Column:
    return F.size(F.filter(f["subfields"], lambda s: s["code"].rlike(f"^[{codes}]$")))


def beyond_summary(held: Column) -> Column:
    """Any of the holdings fields with more than one level of enumeration or of chronology: more than level 3 says."""
    return F.exists(held, lambda f: (_coded(f, "a-f") > 1) | (_coded(f, "i-l") > 1))


def exceeds_summary() -> Column:
    return beyond_summary(tagged("863"))


def single_part_conflict_of(held: Column) -> Column:
    """A single-part item that has several holdings fields, an enumeration, or a run of dates."""
    runs = F.exists(held, lambda f: F.exists(f["subfields"], lambda s: s["code"].rlike("^[i-l]$") & s["value"].contains("-")))
    return (F.substring("leader", 7, 1) == "x") & ((F.size(held) > 1) | F.exists(held, lambda f: _coded(f, "a-f") > 0) | runs)


def single_part_conflict() -> Column:
    return single_part_conflict_of(tagged("863"))


def encoding_level_differs(declared: str) -> Column:
    level = F.substring("leader", 18, 1)
    return ~F.trim(level).isin(*[x.strip() for x in USUAL_LEVELS]) & (level != declared)


def encoding_levels(records: DataFrame) -> DataFrame:
    return records.groupBy(F.substring("leader", 18, 1).alias("level")).agg(F.count("*").alias("n"))


def notation_note(text: Column, scheme: Column) -> Column:
    """What a statement's form says against its declared scheme."""
    looks = F.coalesce(text.rlike(r"\[\d{4}:\d{1,2}(:\d{1,2})?\]"), F.lit(False))
    declared = F.coalesce(F.lower(F.trim(scheme)), F.lit(""))
    return F.when((declared == "usnp") & ~looks, "declared usnp, but not of that form").when((declared == "") & looks, "of the usnp form, which isn't declared").when((declared != "usnp") & looks, F.concat(F.lit("of the usnp form, declared "), declared))


def refuse_unreadable(records: DataFrame) -> None:
    """Raises if any record is damaged, naming the first ten by their place."""
    bad = [r[0] + 1 for r in records.where("unreadable").select("record_index").orderBy("record_index").limit(10).collect()]
    if bad:
        n = records.where("unreadable").count()
        more = f" and {n - len(bad)} more" if n > len(bad) else ""
        raise ValueError(f"damaged records: {', '.join(map(str, bad))}{more}")


def _audited(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            out = [(render.audit(t, fields.convert(grammar.read(t), **options)), *render.round_trip(t, **options)) for t in texts]
            yield pa.RecordBatch.from_arrays([b["text"], pa.array([x[0] for x in out], pa.list_(pa.string())), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["text", "missing", "trip", "rendered"])

    return run


def audit(statements: DataFrame, **options) -> DataFrame:
    """missing (numbers unaccounted for), trip (round trip outcome) and rendered of each distinct statement."""
    return arrow_map(spread(statements.where("text IS NOT NULL").select("text").distinct(), "text"), _audited(options), "text string, missing array<string>, trip string, rendered string")


def tallies(audited: DataFrame) -> DataFrame:
    """One row: distinct statements, those of which nothing was written, those that lost a number without a word, and round trips by outcome."""
    n = lambda c, name: F.count_if(c).alias(name)
    trips = [n(F.col("trip") == t, t.replace(" ", "_")) for t in ("same", "caption only", "drift", "not converted")]
    return audited.agg(F.count("*").alias("statements"), n((F.size("missing") > 0) & (F.col("trip") != "not converted"), "silent"), *trips)


def statuses(read: DataFrame, audited: DataFrame) -> DataFrame:
    """text and status of each distinct statement: fail (nothing written), loss (a number is gone without a word), warn, ok.

    read: text, converted; audited: as audit() gives it.
    """
    once = read.select("text", "converted").groupBy("text").agg(F.any_value("converted").alias("converted"))
    status = F.when(F.col("converted.held"), "fail").when(F.size("missing") > 0, "loss").when(F.size("converted.warnings") > 0, "warn").otherwise("ok")
    return once.join(audited.select("text", "missing"), "text").select("text", status.alias("status"))


def review(read: DataFrame) -> DataFrame:
    """One row for each record: how its statements come out (read: with outcome, converted, parsed)."""
    n = lambda c: F.count_if(c).alias
    return read.groupBy("record_index").agg(
        F.count("*").alias("statements"),
        n(~F.col("converted.held"))("converted"),
        n(F.col("converted.held") & F.col("parsed.belongs_in").isNull())("held"),
        F.array_sort(F.collect_set("parsed.belongs_in")).alias("elsewhere"),
        n(F.col("converted.flagged"))("flagged"),
        n(F.size("converted.left_out") > 0)("left_out"),
    )


def log_rows(read: DataFrame) -> DataFrame:
    """One row for each thing to look at: record, what, statement, details."""
    what = F.when(F.col("parsed.belongs_in").isNotNull(), F.concat(F.lit("belongs in "), "parsed.belongs_in")).when(F.col("converted.held"), "not converted").when(F.col("w.kind").startswith("left_out"), "converted, part left out").otherwise("converted with a note")
    return read.select("record_index", "text", "parsed", "converted", F.explode("converted.warnings").alias("w")).select("record_index", what.alias("what"), "text", F.col("w.text").alias("details"))


def write_log(rows: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark, in record order; the log is one line for each thing to look at."""
    marked = rows.orderBy("record_index", "text", "details").select(F.col("record_index").alias("﻿Record"), F.col("what").alias("What"), F.col("text").alias("866"), F.col("details").alias("Details"))
    marked.coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def search(rows: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Rows that hold the words, whatever their case, in any of the columns."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(words.lower()))


def page(rows: DataFrame, order: list[str], number: int, size: int = 50) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(min(size, 200))
