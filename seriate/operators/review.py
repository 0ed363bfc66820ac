"""What a person sees before anything is written: rows of records, groups of patterns, and what wants a look.

Everything here is a projection or an aggregate of the tables that conversion and clustering give, so a filter can't
disagree with what will be written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriate.operators import quality, reading
from seriate.operators.records import first_value, summary, tagged

MOST_LISTED, MOST_PAGE, MOST_INDICES, SAMPLE = 200, 200, 200, 25
FILTERS = ("all", "held", "leftout", "encoding", "pattern", "parser", "unreviewed", "skipped", "one-pattern")
#: Sources that are no pattern's.
PLAIN_SOURCES = ("parser", "unmatched", "skipped")


# ---- statements -----------------------------------------------------------------------------------------


def uncaptioned_levels(parsed: Column) -> Column:
    """Positions, from 0, of levels that some range states without a caption."""
    of = lambda b: F.filter(F.transform(F.coalesce(b["enum"], F.array().cast("array<struct<caption: string, value: string>>")), lambda e, i: F.when(e["caption"].isNull() | (e["caption"] == ""), i)), lambda i: i.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parsed["ranges"], lambda r: F.concat(of(r["start"]), of(r["end"]))))))


def _none() -> Column:
    return F.array().cast("array<string>")


def decides(parsed: Column) -> Column:
    """What confirming a pattern would change for one statement: elsewhere, reading, caption or nothing."""
    return F.when(parsed["belongs_in"].isNotNull(), "elsewhere").when(F.size(parsed["ranges"]) == 0, "reading").when(F.size(uncaptioned_levels(parsed)) > 0, "caption").otherwise("nothing")


def _first_found(answers: Column) -> Column:
    """Of the answers of a group's statements: elsewhere if all say so, else the weightiest of the rest."""
    rest = F.filter(answers, lambda a: a != "elsewhere")
    return F.when(F.size(rest) == 0, "elsewhere").when(F.array_contains(rest, "reading"), "reading").when(F.array_contains(rest, "caption"), "caption").otherwise("nothing")


def look_at_kinds(outcome: Column, converted: Column) -> Column:
    """Why a statement wants a look: held, to_check or unread, and left_out beside it."""
    own = F.when(outcome.isin("held", "to_check", "unread"), outcome)
    lost = F.when(~outcome.isin("elsewhere", "unread") & (F.size(converted["left_out"]) > 0), "left_out")
    return F.array_compact(F.array(own, lost))


# ---- groups of patterns ---------------------------------------------------------------------------------


def outcome_counts(read: DataFrame, keys: list[str]) -> DataFrame:
    """Statements of each group that are held, to check, lose a value or aren't read; one may count twice."""
    n = lambda c, name: F.count_if(c).alias(name)
    rows = read.withColumn("outcome", reading.outcome(F.col("parsed"), F.col("converted")))
    kinds = look_at_kinds(F.col("outcome"), F.col("converted"))
    return rows.withColumn("kinds", kinds).groupBy(*keys).agg(*[n(F.array_contains("kinds", k), k) for k in ("held", "to_check", "left_out", "unread")])


def annotated(clusters: DataFrame, read: DataFrame) -> DataFrame:
    """Clusters with what confirming them decides, their outcomes, where they come from, and how many want a look.

    read: signature, record_index, text, parsed, converted of the statements.
    """
    rows = read.withColumn("outcome", reading.outcome(F.col("parsed"), F.col("converted"))).withColumn("kinds", look_at_kinds(F.col("outcome"), F.col("converted"))).withColumn("answer", decides(F.col("parsed")))
    n = lambda k: F.count_if(F.array_contains("kinds", k)).alias(k)
    by = rows.groupBy("signature").agg(F.collect_set("answer").alias("answers"), *[n(k) for k in ("held", "to_check", "left_out", "unread")], F.countDistinct("record_index").alias("records"), F.min("parsed.belongs_in").alias("belongs_in"))
    by = by.withColumn("decides", _first_found(F.col("answers"))).drop("answers")
    return clusters.join(by, "signature", "left").withColumn("belongs_in", F.when(F.col("decides") == "elsewhere", F.col("belongs_in")))


def to_look_at(read: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """Each distinct text that wants a look, with why, where it comes first and in how many records; a list of the first."""
    rows = read.withColumn("outcome", reading.outcome(F.col("parsed"), F.col("converted"))).withColumn("kinds", look_at_kinds(F.col("outcome"), F.col("converted"))).where("size(kinds) > 0")
    by = rows.groupBy("text").agg(F.any_value("outcome").alias("outcome"), F.any_value("kinds").alias("kinds"), F.min(F.struct("record_index", "field_index")).alias("first"), F.countDistinct("record_index").alias("records"))
    return by.orderBy("first", "text").limit(most)


def partition(groups: DataFrame, pasted: bool = False) -> DataFrame:
    """part of each group (declined, decides, held, to_check, unread, confirmed, skipped): the first that fits."""
    look = (F.col("held") + F.col("to_check") if pasted else F.col("unread")) > 0
    asks = ~F.col("confirmed") & F.col("declined").isNull() & ~F.col("decides").isin("nothing", "elsewhere")
    part = (
        F.when(F.col("skipped"), "skipped")
        .when((F.col("decides") != "elsewhere") & look & ~asks, "attention")
        .when(F.col("declined").isNotNull(), "complex")
        .when(F.col("confirmed"), "confirmed")
        .when(F.col("decides") == "nothing", "readable")
        .when(F.col("decides") == "elsewhere", "elsewhere")
        .otherwise("open")
    )
    return groups.withColumn("part", part)


def to_confirm(groups: DataFrame, library: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Groups that can be confirmed without asking: readable, no role open, and neither confirmed nor dismissed (pattern_id)."""
    ready = groups.where("regex IS NOT NULL AND declined IS NULL AND decides NOT IN ('reading', 'elsewhere') AND NOT open_roles")
    return ready.join(library.select("pattern_id"), "pattern_id", "left_anti").join(dismissed.select("pattern_id"), "pattern_id", "left_anti")


def outcome_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("held", "to_check", "left_out")])


# ---- records --------------------------------------------------------------------------------------------


def rows(records: DataFrame, converted: DataFrame, read: DataFrame, spec: str = "999$b", level: str = "4", skipped: DataFrame | None = None, clear_existing: bool = False) -> DataFrame:
    """One row for each record, with all that the filters and the counts of the file need.

    converted: as convert_records gives it. read: record_index, parsed, z, x, scheme of the statements. A record that is
    skipped, or keeps holdings fields of its own, has no counts, as nothing will be written to it.
    """
    by = converted.groupBy("record_index").agg(
        F.count_if(F.size("fields_863") > 0).alias("converted"),
        F.count_if((F.size("fields_863") == 0) & F.col("belongs_in").isNull()).alias("held"),
        F.array_sort(F.array_compact(F.collect_list("belongs_in"))).alias("elsewhere"),
        F.count_if("flagged").alias("flagged"),
        F.count_if((F.size("left_out") > 0) & ~F.col("held")).alias("left_out"),
        F.max("left_as_uploaded").alias("left_as_uploaded"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.flatten(F.collect_list("fields_863")).alias("made"),
    )
    bare = read.groupBy("record_index").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(uncaptioned_levels(F.col("parsed")))))).alias("uncaptioned"))
    notes = quality.existing_853_notes(records).groupBy("record_index").agg(F.array_sort(F.collect_list("note")).alias("record_notes"))
    skips = (skipped.select("record_index").distinct() if skipped is not None else records.select("record_index").limit(0)).withColumn("skipped", F.lit(True))
    base = summary(records, spec, "leader", "fields").drop("has_853", "has_863", "unreadable")
    out = base.join(by, "record_index", "left").join(bare, "record_index", "left").join(notes, "record_index", "left").join(skips, "record_index", "left")
    own = F.size(tagged("863"))
    out = out.withColumns({"existing_863": own, "skipped": F.coalesce("skipped", F.lit(False))}).withColumn("kept_existing", (F.col("existing_863") > 0) & F.lit(not clear_existing))
    idle = F.col("skipped") | F.col("kept_existing")
    number = lambda c: F.when(idle, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).alias(c)
    strings = lambda c: F.when(idle, _none()).otherwise(F.coalesce(c, _none())).alias(c)
    written = F.coalesce(F.when(~idle, F.col("made")), F.array().cast("array<struct<tag: string, ind1: string, ind2: string, subfields: array<struct<code: string, value: string>>>>"))
    return out.select(
        *["record_index", "title", "identifier", "issn", "location", "statements", "skipped", "existing_863", "kept_existing"],
        (F.size("statements") > 0).alias("has_866"),
        *[number(c) for c in ("converted", "held", "flagged", "left_out")],
        *[strings(c) for c in ("elsewhere", "sources")],
        F.when(idle, F.array().cast("array<int>")).otherwise(F.coalesce("uncaptioned", F.array().cast("array<int>"))).alias("uncaptioned"),
        (F.coalesce("left_as_uploaded", F.lit(False)) & ~idle).alias("left_as_uploaded"),
        F.coalesce("record_notes", _none()).alias("record_notes"),
        (F.lit(level == "3") & quality.beyond_summary(written)).alias("beyond_level"),
        quality.encoding_level_differs(level).alias("level_differs"),
        quality.single_part_conflict_of(written).alias("single_part"),
    )


def filtered(rows_: DataFrame, name: str, reviewed: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """Rows that a filter lets through: one of FILTERS; reviewed: record_index of those a person has seen."""
    if name not in FILTERS:
        raise ValueError(f"no filter {name}")
    some = lambda c: F.size(c) > 0
    is_pattern = F.exists("sources", lambda s: ~s.isin(*PLAIN_SOURCES))
    kept = {
        "all": F.lit(True),
        "held": ~F.col("skipped") & ((F.col("held") > 0) | (F.col("flagged") > 0) | some("elsewhere") | F.col("left_as_uploaded") | some("record_notes")),
        "leftout": (F.col("left_out") > 0) | F.col("left_as_uploaded"),
        "encoding": F.col("beyond_level") | F.col("level_differs") | F.col("single_part"),
        "pattern": is_pattern,
        "parser": F.array_contains("sources", "parser"),
        "unreviewed": F.lit(True),
        "skipped": F.col("skipped"),
        "one-pattern": F.array_contains("sources", pattern or ""),
    }[name]
    out = rows_.where(kept)
    return out.join(reviewed.select("record_index"), "record_index", "left_anti") if name == "unreviewed" and reviewed is not None else out


def searched(rows_: DataFrame, words: str) -> DataFrame:
    """Rows whose identifier, title, ISSN, location or statements hold the words, whatever their case."""
    hay = F.lower(F.concat_ws(" ", "identifier", "title", "issn", "location", F.array_join("statements", " ")))
    return rows_.where(hay.contains(words.lower())) if words else rows_


def picked(rows_: DataFrame, indices: list[int]) -> DataFrame:
    """The rows of an explicit list of records: each once, at most MOST_INDICES of them, in record order."""
    wanted = sorted(dict.fromkeys(i for i in indices if isinstance(i, int) and i >= 0))[:MOST_INDICES]
    return rows_.where(F.col("record_index").isin(wanted) if wanted else F.lit(False)).orderBy("record_index")


def file_counts(rows_: DataFrame) -> DataFrame:
    """One row for the file: records, with holdings, kept as they are, beyond their level, single parts."""
    n = lambda c, name: F.count_if(c).alias(name)
    return rows_.agg(F.count("*").alias("records"), n(F.col("has_866"), "with_holdings"), n(F.col("kept_existing"), "kept_existing"), n(F.col("beyond_level"), "beyond_level"), n(F.col("single_part"), "single_part"), n(F.col("level_differs"), "level_differs"))


def log(records: DataFrame, converted: DataFrame, rows_: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """The log of a run: record (from 1), identifier, title, what, statement, details; one row for each thing to look at."""
    names = rows_.select("record_index", "identifier", "title")
    gone = F.col("left_as_uploaded")
    what = (
        F.when(F.col("belongs_in").isNotNull(), F.concat(F.lit("Belongs in "), "belongs_in"))
        .when(gone, "Left as uploaded")
        .when(F.col("source") == "skipped", "Skipped by a pattern")
        .when(F.col("held"), "Not converted")
        .when(F.col("w.kind").startswith("left_out"), "Converted, part left out")
        .when(F.col("flagged") & F.array_contains("attention", F.col("w.text")), "Converted, to check")
        .otherwise("Converted, with a note")
    )
    said = converted.select("record_index", "field_index", "split_part", "text", "belongs_in", "left_as_uploaded", "source", "held", "flagged", "attention", F.posexplode("warnings").alias("nth", "w"))
    parts = [said.select("record_index", F.struct(F.lit(0).alias("k"), "field_index", F.coalesce("split_part", F.lit(0)).alias("part"), "nth").alias("at"), what.alias("what"), "text", F.col("w.text").alias("details"))]
    at = lambda k: F.struct(F.lit(k).alias("k"), F.lit(0).alias("field_index"), F.lit(0).alias("part"), F.lit(0).alias("nth"))
    none = F.lit(None).cast("string")
    parts.append(rows_.where("skipped").select("record_index", at(1).alias("at"), F.lit("Record skipped").alias("what"), none.alias("text"), none.alias("details")))
    parts.append(rows_.where("kept_existing AND NOT skipped").select("record_index", at(2).alias("at"), F.lit("Kept as it is").alias("what"), none.alias("text"), F.concat(F.lit("holdings fields of its own: "), F.col("existing_863").cast("string")).alias("details")))
    parts.append(rows_.select("record_index", F.posexplode("record_notes").alias("nth", "details")).select("record_index", F.struct(F.lit(3).alias("k"), F.lit(0).alias("field_index"), F.lit(0).alias("part"), "nth").alias("at"), F.lit("About the record").alias("what"), none.alias("text"), "details"))
    if notes is not None:
        parts.append(notes.where("trim(note) <> ''").select("record_index", at(4).alias("at"), F.lit("Note").alias("what"), none.alias("text"), F.col("note").alias("details")))
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    return everything.join(names, "record_index", "left").select((F.col("record_index") + 1).alias("record"), "identifier", "title", "what", "text", "details", "at")


def write_log(rows_: DataFrame, path: str) -> None:
    """The log as one CSV file of six columns, its first name behind a byte order mark, in record order."""
    names = ("﻿Record", "Identifier", "Title", "What", "866", "Details")
    columns = ("record", "identifier", "title", "what", "text", "details")
    marked = rows_.orderBy("record", "at").select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    marked.coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def by_source(converted: DataFrame) -> DataFrame:
    return converted.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def ranked_examples(read: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The first texts of each signature by place, with where each comes from."""
    nth = F.row_number().over(Window.partitionBy("signature").orderBy("record_index", "field_index"))
    once = read.groupBy("signature", "text").agg(F.min(F.struct("record_index", "field_index")).alias("first"), F.count("*").alias("times"))
    return once.select("signature", "text", "first.*", "times").withColumn("nth", nth).where(F.col("nth") <= most)


__all__ = ["FILTERS", "annotated", "by_source", "decides", "file_counts", "filtered", "first_value", "log", "look_at_kinds", "outcome_counts", "outcome_totals", "partition", "picked", "ranked_examples", "rows", "searched", "to_confirm", "to_look_at", "uncaptioned_levels", "write_log"]
