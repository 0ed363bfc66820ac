"""Records: conversion of all statements of a record, and the record rewritten.

Each distinct statement is read and converted once for each set of caption fields and settings that it meets. The
statements of a record are then folded in order, by what their conversions have in common alone (patterns, kinds of
dates, numbers of fields); the fields themselves pass through untouched, and links and sequence numbers are written into
them by native expressions.

The fold: a statement that is held doesn't break a run. A statement joins the open run if its caption pattern agrees
with the run's on all they share and one holds the other; the run's pattern then widens to the larger. Otherwise it
opens a run with the next free link. Fields of a run are numbered through, and its first statement carries the
caption field of its fullest one. Where months change to seasons, or back, the statement is flagged.

Defined results: a statement without a text is held; statements of a null record_index are one record; rows of the
same place are folded in an order of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriate.functions import fields
from seriate.functions.schemas import FIELD, PARSED, RECORD_FIELDS, SETTINGS
from seriate.operators.code import arrow_map, spread
from seriate.operators.reading import arrow_schema, converted_row, reader_of, table_of

_LIGHT = "pattern array<struct<code: string, value: string>>, kinds array<string>, size int, loses boolean"
_CONVERTED = f"link string, conformed boolean, held boolean, flagged boolean, belongs_in string, field_853 {FIELD}, fields_863 array<{FIELD}>, warnings array<struct<kind: string, text: string>>, attention array<string>, left_out array<string>"
CONVERTED_STATEMENT = f"record_index bigint, field_index int, split_part int, text string, source string, link string, run int, first int, field_853 {FIELD}, fields_863 array<{FIELD}>, held boolean, conformed boolean, flagged boolean, merged boolean, belongs_in string, left_as_uploaded boolean, change string, warnings array<struct<kind: string, text: string>>, attention array<string>, left_out array<string>"
#: Subfields of an 866 that the new fields account for.
ACCOUNTED = ("a", "x", "z", "8")
#: What becomes of statements that would lose a value: they convert, they are held, or their record is left as it is.
POLICIES = ("convert", "statement", "record")


def pattern_of(field: dict) -> dict[str, str]:
    return {c: v for c, v in field["subfields"] if c not in "8"}


def compatible(a: dict[str, str], b: dict[str, str], merge: bool = True) -> bool:
    """Equal on what both have, and one within the other; or equal, if patterns aren't to be merged."""
    if not merge:
        return list(a.items()) == list(b.items())
    return all(a[k] == b[k] for k in a.keys() & b.keys()) and (a.keys() <= b.keys() or b.keys() <= a.keys())


def light(c: dict) -> dict:
    """What the fold needs of a conversion."""
    kinds = [] if c["held"] else sorted(set(fields.chron_kinds(c["ranges"])))
    pattern = [] if c["field_853"] is None else [{"code": k, "value": v} for k, v in pattern_of(c["field_853"]).items()]
    return {"pattern": pattern, "kinds": kinds, "size": len(c["fields_863"]), "loses": bool(c["left_out"]) and not c["held"]}


def folded(rows: list[dict], taken: set[str], on_record: set[str], merge: bool = True, policy: str = "convert") -> list[dict]:
    """Links and places of the statements of one record, in order.

    rows: held, conformed, link, pattern, kinds, size, loses, origin (of a statement that a person split, else None).
    taken: links of the record's caption fields; on_record: the kinds of date that they declare.
    """
    losing = [i for i, r in enumerate(rows) if r["loses"]] if policy != "convert" else []
    if losing and policy == "record":
        return [_nothing() | {"left": True, "held": True} for _ in rows]
    out = [_nothing() | {"held": r["held"] or i in losing, "by_policy": i in losing} for i, r in enumerate(rows)]
    runs, current, last = [], None, None
    for i, r in enumerate(rows):
        if out[i]["held"]:
            continue
        if r["conformed"]:
            current = next((x for x in runs if x["link"] == r["link"]), None)
            if current is None:
                current = {"link": r["link"], "pattern": None, "head": None, "members": []}
                runs.append(current)
        elif current is None or current["link"] is not None or not compatible(current["pattern"], r["pattern"], merge):
            current = {"link": None, "pattern": r["pattern"], "head": i, "members": []}
            runs.append(current)
        elif r["pattern"] != current["pattern"]:
            out[i]["merged"] = True
            if len(r["pattern"]) > len(current["pattern"]):
                current["pattern"], current["head"] = r["pattern"], i
        current["members"].append(i)
        if len(r["kinds"]) == 1:
            kind = r["kinds"][0]
            if last is not None and rows[last]["kinds"][0] != kind:
                own = r["origin"] is not None and r["origin"] == rows[last]["origin"]
                out[i] |= {"change": "split" if own else "between", "before": rows[last]["kinds"][0]}
            elif not r["conformed"] and on_record and kind not in on_record:
                out[i] |= {"change": "existing", "before": min(on_record)}
            last = i
    free = (str(i) for i in range(1, len(runs) + len(taken) + 1) if str(i) not in taken)
    for n, run in enumerate(runs, 1):
        link, first = run["link"] or next(free), 1
        for i in run["members"]:
            out[i] |= {"run": n, "link": link, "first": first}
            first += rows[i]["size"]
        if run["head"] is not None:
            out[run["members"][0]]["head"] = run["head"]
            out[run["members"][0]]["beside"] = bool(taken)
    return out


def _nothing() -> dict:
    return {"run": None, "link": None, "first": None, "head": None, "merged": False, "change": None, "before": None, "left": False, "by_policy": False, "beside": False}


def _said(row: dict, kinds: list[str], left_out: list[str]) -> list[str]:
    """What the fold has to say about a statement, beside what its conversion says."""
    out = []
    if row["change"] in ("between", "split"):
        out.append(f"changes from {row['before']} to {kinds[0]} between statements" + (", where the statement was split" if row["change"] == "split" else ""))
    elif row["change"] == "existing":
        out.append(f"gives a {kinds[0]}, but the record's caption field a {row['before']}")
    if row["beside"]:
        out.append(f"a caption field {row['link']} is added beside those of the record")
    if row["by_policy"]:
        out.append("held by the setting on what would be left out: " + "; ".join(left_out))
    if row["left"]:
        out.append("its record is left as it is, as something would be left out")
    return out


def fold(statements: list[dict], existing: list[dict], merge: bool = True, policy: str = "convert", **options) -> list[dict]:
    """Statements (field_index, parsed, perhaps origin) of one record, in order, with links, sequence numbers and caption fields."""
    made = [fields.convert(s["parsed"], existing=existing, **options) for s in statements]
    rows = [c | light(c) | {"origin": s.get("origin")} for c, s in zip(made, statements, strict=True)]
    for r in rows:
        r["pattern"] = {x["code"]: x["value"] for x in r["pattern"]}
    taken = {fields.slots(f)["link"] for f in existing}
    out = folded(rows, taken, {fields.slots(f)["kind"] for f in existing} - {None}, merge, policy)
    for s, c, r, o in zip(statements, made, rows, out, strict=True):
        said = _said(o, r["kinds"], c["left_out"])
        o["warnings"] = c["warnings"] + [{"kind": "note", "text": x} for x in said]
        o |= {"field_index": s["field_index"], "belongs_in": c["belongs_in"], "conformed": c["conformed"] and not o["held"], "flagged": c["flagged"] or o["change"] in ("between", "existing")}
        head = o["head"] is not None and made[o["head"]]["field_853"]
        o["field_853"] = head and head | {"subfields": [("8", o["link"]), *head["subfields"][1:]]} or None
        o["fields_863"] = [] if o["held"] else [f | {"subfields": [("8", f"{o['link']}.{o['first'] + i}"), *f["subfields"][1:]]} for i, f in enumerate(c["fields_863"])]
    return out


def _converter(library: list | None, fallback: str, options: dict):
    """Reads and converts each distinct (text, existing, settings)."""
    ddl = f"text string, existing array<{FIELD}>, settings {SETTINGS}, source string, {_CONVERTED}, {_LIGHT}"
    schema, read = arrow_schema(ddl), reader_of(library, fallback)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                source, parsed = read(r["text"])
                own = {k: v for k, v in (r["settings"] or {}).items() if v is not None}
                overrides = {x["level"]: x["caption"] for x in own.pop("captions", [])}
                existing = [f | {"subfields": [(x["code"], x["value"]) for x in f["subfields"]]} for f in r["existing"] or []]
                for x in parsed["ranges"]:
                    for edge in (x["start"], x["end"]):
                        if edge:  # a caption that the statement states isn't replaced
                            edge["enum"] = [(c or (v and overrides.get(i)), v) for i, (c, v) in enumerate(edge["enum"])]
                c = fields.convert(parsed, existing=existing, **options | own)
                rows.append(r | {"source": source} | {k: v for k, v in converted_row(c).items() if k != "switch"} | light(c))
            yield from table_of(rows, schema).to_batches()

    return run, ddl


_FOLDED = "run int, link string, first int, head int, merged boolean, change string, left boolean, by_policy boolean"


def _folder(columns: str, policy: str):
    """The fold over partitions in record order; a record may go on in the next batch."""
    schema = arrow_schema(f"{columns}, said array<string>, {_FOLDED}")

    def done(table: pa.Table) -> pa.RecordBatch:
        keep = ("held", "conformed", "link", "pattern", "kinds", "size", "loses", "left_out", "origin", "taken", "on_record", "merge")
        light_ = table.select(keep).to_pylist()
        ids = table["record_index"].to_pylist()
        out, first = [], 0
        while first < len(ids):
            end = first + 1
            while end < len(ids) and ids[end] == ids[first]:
                end += 1
            rows = light_[first:end]
            for r in rows:
                r["pattern"] = {x["code"]: x["value"] for x in r["pattern"]}
            for r, o in zip(rows, folded(rows, set(rows[0]["taken"]), set(rows[0]["on_record"]), rows[0]["merge"], policy), strict=True):
                out.append(o | {"said": _said(o, r["kinds"], r["left_out"]), "head": None if o["head"] is None else o["head"] + first})
            first = end
        heads = pa.array([o["head"] for o in out], pa.int32())
        made = {n: pa.array([o[n] for o in out], schema.field(n).type) for n in ("said", "run", "link", "first", "head", "merged", "change", "left", "by_policy")}
        made["held"] = pa.array([o["held"] for o in out])
        made["field_853"] = table["field_853"].combine_chunks().take(heads) if len(table) else table["field_853"]
        cols = [made[n] if n in made else table[n] for n in schema.names]
        return pa.table(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not len(b):
                continue
            table = pa.Table.from_batches([b])
            last = b["record_index"][-1]
            same = pc.equal(b["record_index"], last) if last.is_valid else pc.is_null(b["record_index"])
            start = pc.index(same, True).as_py()  # in record order, so all behind it are of the last record
            if start:
                held.append(table.slice(0, start))
                yield from done(pa.concat_tables(held)).to_batches()
                held = []
            elif held and held[-1]["record_index"][-1] != last:
                yield from done(pa.concat_tables(held)).to_batches()
                held = []
            held.append(table.slice(start))
        if held:
            yield from done(pa.concat_tables(held)).to_batches()

    return run, f"{columns}, said array<string>, {_FOLDED}"


def convert_records(statements: DataFrame, existing: DataFrame | None = None, *, library: list | None = None, fallback: str = "parser", settings: DataFrame | None = None, separate: DataFrame | None = None, policy: str = "convert", merge: bool = True, **options) -> DataFrame:
    """One row for each statement (record_index, field_index, text, perhaps split_part or origin) of each record.

    origin: the place of the 866 that a person split the statement from; with split_part, its field_index.
    existing: record_index, existing (array of 853 fields). library, fallback: patterns that read statements, as
    patterns.read_by takes them. settings: record_index and settings of single records. separate: record_index of
    records whose patterns aren't merged. policy: one of POLICIES.
    """
    place = F.col("field_index").cast("int")
    origin = F.col("origin").cast("int") if "origin" in statements.columns else F.when(F.col("split_part").isNotNull(), place) if "split_part" in statements.columns else F.lit(None).cast("int")
    rows = statements.select("record_index", place.alias("field_index"), origin.alias("origin"), (F.col("split_part").cast("int") if "split_part" in statements.columns else F.lit(None).cast("int")).alias("split_part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(existing.select("record_index", "existing"), "record_index", "left") if existing is not None else rows.withColumn("existing", F.lit(None).cast(f"array<{FIELD}>"))
    rows = rows.withColumn("existing", F.when(F.size("existing") > 0, F.col("existing")))
    rows = rows.join(settings.select("record_index", "settings"), "record_index", "left") if settings is not None else rows.withColumn("settings", F.lit(None).cast(SETTINGS))
    rows = rows.join(separate.select("record_index").distinct().withColumn("apart", F.lit(True)), "record_index", "left") if separate is not None else rows.withColumn("apart", F.lit(None).cast("boolean"))
    rows = rows.withColumn("case", F.xxhash64("existing", "settings"))
    run, ddl = _converter(library, fallback, options)
    made = arrow_map(spread(rows.select("text", "existing", "settings").distinct(), "text"), run, ddl).withColumn("case", F.xxhash64("existing", "settings")).drop("existing", "settings")
    code = lambda f, c: F.get(F.filter(f["subfields"], lambda s: s["code"] == c), F.lit(0))["value"]
    old = F.coalesce("existing", F.array().cast(f"array<{FIELD}>"))
    taken = F.array_compact(F.transform(old, lambda f: F.trim(F.substring_index(code(f, "8"), ".", 1))))
    said = F.flatten(F.transform(old, lambda f: F.transform(F.filter(f["subfields"], lambda s: s["code"].rlike("^[a-m]$")), lambda s: F.lower(F.trim(s["value"])))))
    on_record = F.transform(F.filter(F.array_distinct(said), lambda v: v.isin("(month)", "(season)")), lambda v: F.substring(v, 2, 20))
    on_record = F.transform(on_record, lambda v: F.rtrim(v, F.lit(")")))
    both = rows.select("*", taken.alias("taken"), on_record.alias("on_record"), (F.lit(merge) & F.col("apart").isNull()).alias("merge")).drop("existing", "settings", "apart")
    joined = both.join(made, ["text", "case"]).drop("case")
    ordered = joined.repartition("record_index").sortWithinPartitions("record_index", "field_index", F.coalesce("split_part", F.lit(0)), "text")
    fold_, folded_ddl = _folder(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields if f.name != "link"), policy)
    out = arrow_map(ordered, fold_, folded_ddl)
    stamped = lambda f, value: f.withField("subfields", F.transform(f["subfields"], lambda s: F.when(s["code"] == "8", s.withField("value", value)).otherwise(s)))
    own = F.transform("fields_863", lambda f, i: stamped(f, F.concat("link", F.lit("."), (F.col("first") + i).cast("string"))))
    notes = F.transform("said", lambda x: F.struct(F.lit("note").alias("kind"), x.alias("text")))
    asks = F.col("change").isin("between", "existing")
    return out.select(
        *["record_index", "field_index", "split_part", "text", "source", "link", "run", "first"],
        F.when(F.col("field_853").isNotNull(), stamped(F.col("field_853"), F.col("link"))).alias("field_853"),
        F.when(F.col("held"), F.array().cast(f"array<{FIELD}>")).otherwise(own).alias("fields_863"),
        "held",
        (F.col("conformed") & ~F.col("held")).alias("conformed"),
        (F.col("flagged") | F.coalesce(asks, F.lit(False))).alias("flagged"),
        *["merged", "belongs_in", F.col("left").alias("left_as_uploaded"), "change"],
        F.concat("warnings", notes).alias("warnings"),
        F.concat("attention", F.when(asks, F.slice("said", 1, 1)).otherwise(F.array().cast("array<string>"))).alias("attention"),
        F.when(F.col("held") & ~F.col("by_policy") & ~F.col("left"), F.array().cast("array<string>")).otherwise(F.col("left_out")).alias("left_out"),
    )


def fields_863(converted: DataFrame) -> DataFrame:
    """One row for each holdings field, with link and sequence number."""
    rows = converted.select("record_index", "field_index", "link", "first", F.posexplode("fields_863").alias("range_index", "field"))
    return rows.withColumn("seq", F.col("first") + F.col("range_index")).drop("first")


# ---- record fields ----------------------------------------------------------------------------------------


def tagged(tag: str) -> Column:
    return F.filter("fields", lambda f: f["tag"] == tag)


def first_value(tag: str, code: str | None) -> Column:
    """The first subfield code of the first field with this tag; of control fields all data."""
    f = F.get(tagged(tag), F.lit(0))
    if tag < "010" or code is None:
        return F.coalesce(f["data"], F.lit(""))
    return F.coalesce(F.get(F.filter(f["subfields"], lambda s: s["code"] == code), F.lit(0))["value"], F.lit(""))


def identifier_spec(text: str) -> tuple[str, str | None] | None:
    """999$b, 999 $b, 999b, 999|b or 001 as tag and code."""
    import re

    m = re.fullmatch(r"(\d{3})\s*[$|]?\s*([A-Za-z0-9])?", (text or "").strip())
    if not m or (m[2] is None) != (m[1] < "010"):
        return None
    return m[1], m[2] and m[2].lower()


def summary(records: DataFrame, spec: str = "999$b", *more: str) -> DataFrame:
    """Title, identifier, ISSN, location and presence of holdings fields of each record, and more of its columns."""
    found = identifier_spec(spec)
    title = F.regexp_replace(F.trim(F.concat_ws(" ", F.nullif(first_value("245", "a"), F.lit("")), F.nullif(first_value("245", "b"), F.lit("")))), r"[ /:]+$", "")
    place = F.concat_ws(" > ", F.nullif(first_value("852", "b"), F.lit("")), F.nullif(first_value("852", "c"), F.lit("")))
    return records.select(
        "record_index",
        F.when(title == "", F.concat(F.lit("Record "), F.col("record_index") + 1)).otherwise(title).alias("title"),
        (first_value(*found) if found else F.lit("")).alias("identifier"),
        first_value("022", "a").alias("issn"),
        place.alias("location"),
        F.transform(tagged("866"), lambda f: F.get(F.filter(f["subfields"], lambda s: s["code"] == "a"), F.lit(0))["value"]).alias("statements"),
        (F.size(tagged("853")) > 0).alias("has_853"),
        (F.size(tagged("863")) > 0).alias("has_863"),
        "unreadable",
        *more,
    )


def statements(records: DataFrame) -> DataFrame:
    """One row for each 866 with a text; origin, where records have split_of."""
    split_of = F.col("split_of") if "split_of" in records.columns else F.lit(None).cast("array<int>")
    rows = records.select("record_index", split_of.alias("split_of"), F.posexplode("fields").alias("field_index", "f")).where("f.tag = '866'")
    first = lambda code: F.get(F.filter("f.subfields", lambda s: s["code"] == code), F.lit(0))["value"]
    text = F.trim(first("a")).alias("text")
    return rows.select("record_index", "field_index", text, F.col("f.ind1").alias("ind1"), F.col("f.ind2").alias("ind2"), first("z").alias("z"), first("x").alias("x"), first("2").alias("scheme"), F.get("split_of", F.col("field_index")).alias("origin")).where("text <> ''")


def existing_853s(records: DataFrame) -> DataFrame:
    plain = F.transform(tagged("853"), lambda f: F.struct(f["tag"].alias("tag"), f["ind1"].alias("ind1"), f["ind2"].alias("ind2"), f["subfields"].alias("subfields")))
    return records.select("record_index", plain.alias("existing"))


def apply(records: DataFrame, converted: DataFrame, remove_866: bool = False, clear_existing: bool = False) -> DataFrame:
    """The records with the new fields in tag order.

    A record with holdings fields of its own is kept as it is, unless clear_existing, which takes its caption and
    holdings fields away whatever is written. So is a record that the policy leaves as it was uploaded. An 866 goes only
    if its own statement wrote fields, and if it holds nothing that they don't account for. Notes of an 866 go to the
    last holdings field of its statement.
    """
    left = F.max("left_as_uploaded") if "left_as_uploaded" in converted.columns else F.lit(False)
    wrote = F.when(~F.col("held"), F.struct("field_index", "field_853", "fields_863"))
    new = converted.groupBy("record_index").agg(F.sort_array(F.collect_list(wrote)).alias("made"), left.alias("left__"))
    rows = records.join(new, "record_index", "left")
    empty = F.array().cast(f"array<struct<field_index: int, field_853: {FIELD}, fields_863: array<{FIELD}>>>")
    rows = rows.withColumn("made", F.coalesce("made", empty))
    keeps = (F.size(tagged("863")) > 0) & F.lit(not clear_existing)
    notes = lambda i: F.filter(F.get("fields", i)["subfields"], lambda s: s["code"].isin("x", "z"))
    full = lambda f: F.struct(F.lit(0).alias("pos"), f["tag"].alias("tag"), f["ind1"].alias("ind1"), f["ind2"].alias("ind2"), F.lit(None).cast("string").alias("data"), f["subfields"].alias("subfields"))
    noted = lambda m: F.transform(m["fields_863"], lambda f, i: F.when(i == F.size(m["fields_863"]) - 1, f.withField("subfields", F.concat(f["subfields"], notes(m["field_index"])))).otherwise(f))
    captions = F.transform(F.filter(F.transform("made", lambda m: m["field_853"]), lambda f: f.isNotNull()), full)
    holdings = F.transform(F.flatten(F.transform("made", noted)), full)
    link = lambda f: F.substring_index(F.get(F.filter(f["subfields"], lambda s: s["code"] == "8"), F.lit(0))["value"], ".", 1)
    links_ = F.transform(holdings, link)
    gone = F.transform("made", lambda m: m["field_index"])
    whole = lambda f: F.size(F.array_except(F.transform(f["subfields"], lambda s: s["code"]), F.array(*map(F.lit, ACCOUNTED)))) == 0
    kept = F.filter(
        F.transform("fields", lambda f, i: F.struct(f.alias("f"), i.alias("i"))),
        lambda x: ~(
            ((x["f"]["tag"] == "863") & (F.lit(clear_existing) | F.array_contains(links_, link(x["f"]))))
            | ((x["f"]["tag"] == "853") & (F.lit(clear_existing) | F.array_contains(F.transform(captions, link), link(x["f"]))))
            | (F.lit(remove_866) & (x["f"]["tag"] == "866") & F.array_contains(gone, x["i"]) & whole(x["f"]))
        ),
    )
    merged = F.concat(F.transform(kept, lambda x: x["f"]), captions, holdings)
    ordered = F.array_sort(F.transform(merged, lambda f, i: F.struct(f["tag"].alias("tag"), i.alias("i"), f.alias("f"))), lambda a, b: F.when(a["tag"] < b["tag"], -1).when(a["tag"] > b["tag"], 1).otherwise(a["i"] - b["i"]))
    renumbered = F.transform(ordered, lambda x, i: x["f"].withField("pos", i)).cast(RECORD_FIELDS)
    same = keeps | F.coalesce("left__", F.lit(False)) | ((F.size("made") == 0) & F.lit(not clear_existing))
    return rows.withColumn("fields", F.when(same, F.col("fields")).otherwise(renumbered)).drop("made", "left__")


__all__ = ["PARSED", "apply", "convert_records", "existing_853s", "fields_863", "fold", "statements", "summary"]
