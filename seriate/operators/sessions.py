"""A run over a file: what was uploaded, what people decided, and the records that follow from both.

rebuilt() is a pure function of the upload and the decisions, so any decision can be changed and the file written again.
Decisions are what people made one by one: they are few, and travel with the plan; records never come to the driver.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriate.functions import fields
from seriate.functions.schemas import SETTINGS
from seriate.operators import decisions, patterns, quality, reading, records, reports
from seriate.sources import marc

log = logging.getLogger(__name__)


# ---- what a run is asked for ------------------------------------------------------------------------------


def flag(value, default: bool = False) -> bool:
    """A yes or no as documents give it; of words, only the empty one, 0, false and no say no."""
    if value is None:
        return default
    return value.strip().lower() not in ("", "0", "false", "no") if isinstance(value, str) else bool(value)


def indices(value) -> frozenset[int]:
    """Record numbers of a list, whatever else it holds."""
    out = set()
    for x in value if isinstance(value, (list, tuple, set, frozenset)) else ():
        try:
            out.add(int(x))
        except (TypeError, ValueError):
            log.info("%r is no record number", x)
    return frozenset(i for i in out if i >= 0)


@dataclass(frozen=True)
class Options:
    """How records are converted."""

    preset: str = "standard"
    overrides: str = "{}"  # JSON, so that equal options are equal
    frequency: str = ""
    per_higher: str = ""
    continuity: str = "r"
    level: str = "4"
    fallback: str = "parser"
    policy: str = "convert"
    remove_866: bool = False
    clear_existing: bool = False
    skipped: frozenset[int] = field(default_factory=frozenset)
    separate: frozenset[int] = field(default_factory=frozenset)

    @classmethod
    def of(cls, request: dict | None) -> Options:
        """Options of a request; what can't be used gives way to its default."""
        r = request or {}
        frequency = str(r.get("frequency") or "")
        return cls(
            preset=str(r.get("convention") or "standard"),
            overrides=json.dumps(r.get("convention_overrides") or {}, sort_keys=True),
            frequency=frequency if frequency in fields.FREQUENCIES else "",
            per_higher=fields.units(str(r.get("units_per_higher") or "")),
            continuity=str(r.get("numbering_continuity", "r") or ""),
            level=str(r.get("holdings_level")) if str(r.get("holdings_level")) in fields.LEVELS else "4",
            fallback="off" if not flag(r.get("parser_fallback"), True) else "strict" if flag(r.get("parser_strict")) else "parser",
            policy=r.get("left_out_policy") if r.get("left_out_policy") in records.POLICIES else "convert",
            remove_866=flag(r.get("remove_866")),
            clear_existing=flag(r.get("clear_existing_853_863")),
            skipped=indices(r.get("skip_records")),
            separate=indices(r.get("keep_separate")),
        )

    def conversion(self) -> dict:
        conv, _ = fields.resolve(self.preset, json.loads(self.overrides))
        return {"conv": conv, "frequency": self.frequency, "per_higher": self.per_higher, "continuity": self.continuity, "level": self.level}


# ---- what is kept between requests -------------------------------------------------------------------------


class Store:
    """Files by kind and name, each kept for its kind's time from its last use."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _path(self, kind: str, name: str) -> Path:
        return self.folder / kind / uuid.UUID(name).hex  # anything but a name that this store gave is refused

    def save(self, kind: str, body: bytes, name: str | None = None) -> str:
        self.sweep()
        name = name or uuid.uuid4().hex
        path = self._path(kind, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_bytes(body)
        part.replace(path)
        return name

    def load(self, kind: str, name: str, refresh: bool = True) -> bytes | None:
        path = self._path(kind, name)
        if not path.exists() or path.stat().st_mtime + reports.KEPT[kind] < time.time():
            return None
        if refresh:
            path.touch()
        return path.read_bytes()

    def sweep(self) -> int:
        """Deletes what has outlived its time; returns how many."""
        gone = [p for kind, seconds in reports.KEPT.items() for p in (self.folder / kind).glob("*") if p.stat().st_mtime + seconds < time.time()]
        for p in gone:
            p.unlink(missing_ok=True)
        return len(gone)


def library_from(raw: bytes | str | None) -> list[patterns.Pattern]:
    """The patterns of a stored library; one that can't be read is an empty one, and is said in the log."""
    if not raw:
        return []
    found, errors = patterns.load(raw, probe=False)  # its expressions were tried when they came in
    if errors:
        log.warning("stored library: %s", "; ".join(errors))
    return found


def library_text(library: list[patterns.Pattern]) -> str:
    return json.dumps(patterns.export(library), indent=2, ensure_ascii=False)


#: What people decide, by section; batch is null until there is a run over the file.
SECTIONS = {"records": dict, "batch": dict, "edits": dict, "notes": dict, "record_853": dict}


def decisions_from(raw: bytes | str | None) -> dict:
    """Stored decisions, each section of its own type; what can't be read is left aside and said in the log."""
    try:
        found = json.loads(raw) if raw else {}
    except ValueError:
        log.warning("stored decisions can't be read; they are left aside")
        found = {}
    found = found if isinstance(found, dict) else {}
    return {k: found[k] if isinstance(found.get(k), kind) else None if k == "batch" else {} for k, kind in SECTIONS.items()}


# ---- the upload -------------------------------------------------------------------------------------------


def uploaded(spark: SparkSession, path: str, spec: str = "999$b") -> dict[str, DataFrame]:
    """records, statements, summary and identifier candidates of MARC files; raises if a record is damaged."""
    spark.dataSource.register(marc.MarcSource)
    found = marc.numbered(spark.read.format("marc2709").load(path))
    quality.refuse_unreadable(found)
    return {"records": found, "statements": records.statements(found), "summary": records.summary(found, spec), "identifiers": quality.identifier_candidates(found)}


# ---- conversion -------------------------------------------------------------------------------------------


def settings_of(record_853: DataFrame) -> DataFrame:
    """record_index, settings of rows (record_index, frequency, per_higher, continuity, captions); null is not set."""
    return record_853.select("record_index", F.struct("frequency", "per_higher", "continuity", "captions").cast(SETTINGS).alias("settings"))


def _listed(spark: SparkSession, numbers: Iterable[int]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in sorted(numbers)], "record_index long")


def converted(current: DataFrame, options: Options, library: list | None = None, settings: DataFrame | None = None) -> DataFrame:
    """The conversion of the statements of records, under one set of options."""
    spark = current.sparkSession
    existing = None if options.clear_existing else records.existing_853s(current)
    separate = _listed(spark, options.separate) if options.separate else None
    return records.convert_records(records.statements(current), existing, library=library, fallback=options.fallback, settings=settings, separate=separate, policy=options.policy, **options.conversion())


def rebuilt(upload: DataFrame, *, batch: Options | None = None, own: dict[int, Options] | None = None, library: list | None = None, settings: DataFrame | None = None, edits: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """The records of the file as decided: each takes the first that applies of a skip by the run over the file, a
    decision on it alone, the run over the file, and nothing. decided: skipped, own, batch or none."""
    current = decisions.edited_records(upload, edits, splits)
    skipped = batch.skipped if batch else frozenset()
    alone = {i: o for i, o in (own or {}).items() if i not in skipped}
    plans: dict[Options, list[int]] = {}
    for i, o in alone.items():
        plans.setdefault(replace(o, skipped=frozenset()), []).append(i)
    index = F.col("record_index")
    is_skipped, is_own = index.isin(sorted(skipped)) if skipped else F.lit(False), index.isin(sorted(alone)) if alone else F.lit(False)

    def written(rows: DataFrame, options: Options, name: str) -> DataFrame:
        made = converted(rows, options, library, settings)
        return records.apply(rows, made, options.remove_866, options.clear_existing).withColumn("decided", F.lit(name))

    parts = [written(current.where(index.isin(sorted(numbers))), options, "own") for options, numbers in plans.items()]
    parts.append(current.where(is_skipped).withColumn("decided", F.lit("skipped")))
    rest = current.where(~is_skipped & ~is_own)
    parts.append(written(rest, batch, "batch") if batch else rest.withColumn("decided", F.lit("none")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*upload.columns, "decided")


def preview(statements: DataFrame, library: list[patterns.Pattern], candidate: patterns.Pattern, fallback: str = "parser") -> DataFrame:
    """Each distinct statement with the library as it is and with one more pattern before all others: text, source,
    before, after (fields as they are shown), differs."""
    first = replace(candidate, priority=max([p.priority for p in library], default=0) + 1)
    texts = statements.where("text IS NOT NULL").select("text").distinct()

    def shown(own: list[patterns.Pattern], name: str) -> DataFrame:
        # each text alone, as a record of its own
        rows = texts.select(F.xxhash64("text").alias("record_index"), F.lit(0).alias("field_index"), "text")
        made = records.convert_records(rows, library=own, fallback=fallback)
        lines = F.concat(F.array_compact(F.array(F.when(F.col("field_853").isNotNull(), reading.display(F.col("field_853"))))), F.transform("fields_863", reading.display))
        return made.select("text", F.col("source").alias(f"{name}_source"), lines.alias(name))

    both = shown(library, "before").join(shown([first, *library], "after"), "text")
    return both.select("text", F.col("after_source").alias("source"), "before", "after", (F.col("before") != F.col("after")).alias("differs"))
