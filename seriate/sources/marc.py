"""MARC records in ISO 2709: a Spark data source that reads and writes them, and text corpora of statements.

spark.dataSource.register(MarcSource); spark.read.format("marc2709").load(path)

A file is cut by bytes, so the driver reads none of it: a task takes the records that begin in its stretch, and finds
the first of them behind the next record end. Record numbers ascend by file and place; numbered() makes them dense.
A record that can't be decoded keeps its place and is marked unreadable. Paths are those that Python can open on the
executors; for other stores, give records() a DataFrame of spark.read.format("binaryFile").
"""

from __future__ import annotations

import glob
import mmap
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from seriate.functions.schemas import RECORDS

# Fixed values of the format: field, record and subfield ends.
FIELD_END, RECORD_END, SUBFIELD = b"\x1e", b"\x1d", b"\x1f"
MOST_FIELD, MOST_RECORD = 9_999, 99_999
SPLIT_BYTES = 16 << 20
#: Bits of a record's number within its stretch.
PLACE_BITS = 33


def decode(data: bytes) -> tuple[str, list[dict]] | None:
    """Leader and fields of one record, or None."""
    try:
        leader, base = data[:24].decode("ascii"), int(data[12:17])
        directory = data[24 : base - 1]
        if len(directory) % 12 or data[base - 1 : base] != FIELD_END:
            return None
        out = []
        for i in range(0, len(directory), 12):
            entry = directory[i : i + 12].decode("ascii")
            tag, size, start = entry[:3], int(entry[3:7]), int(entry[7:])
            body = data[base + start : base + start + size].rstrip(FIELD_END)
            if tag < "010":
                out.append({"pos": len(out), "tag": tag, "ind1": None, "ind2": None, "data": body.decode("utf-8", "replace"), "subfields": []})
                continue
            text = body.split(SUBFIELD)
            ind = text[0].decode("utf-8", "replace").ljust(2)
            subs = [{"code": s[:1].decode("utf-8", "replace"), "value": s[1:].decode("utf-8", "replace")} for s in text[1:] if s]
            out.append({"pos": len(out), "tag": tag, "ind1": ind[0], "ind2": ind[1], "data": None, "subfields": subs})
        return leader, out
    except (ValueError, UnicodeDecodeError):
        return None


def encode(leader: str, fields: list[dict]) -> bytes:
    """A record's bytes; raises ValueError where the format's numbers can't say its lengths."""
    directory, body = b"", b""
    for f in fields:
        if f["tag"] < "010":
            data = (f["data"] or "").encode()
        else:
            data = f"{f['ind1'] or ' '}{f['ind2'] or ' '}".encode() + b"".join(SUBFIELD + s["code"].encode() + s["value"].encode() for s in f["subfields"])
        data += FIELD_END
        if len(data) > MOST_FIELD:
            raise ValueError(f"field {f['tag']} takes {len(data)} bytes; the format has room for {MOST_FIELD}")
        directory += f"{f['tag']}{len(data):04d}{len(body):05d}".encode()
        body += data
    base = 24 + len(directory) + 1
    if base + len(body) + 1 > MOST_RECORD:
        raise ValueError(f"the record takes {base + len(body) + 1} bytes; the format has room for {MOST_RECORD}")
    head = f"{base + len(body) + 1:05d}{(leader or '').ljust(24)[5:9]}a{(leader or '').ljust(24)[10:12]}{base:05d}{(leader or '').ljust(24)[17:20]}4500"
    return head.encode() + directory + FIELD_END + body + RECORD_END


def _lengths(data: bytes | mmap.mmap, at: int = 0) -> Iterator[tuple[int, int]]:
    """Start and end of each record; where a length doesn't hold, the next record end counts."""
    while at < len(data):
        if not data[at : at + 5].strip(b"\r\n\x00 "):
            at += 1
            continue
        head = data[at : at + 5]
        end = at + int(head) if head.isdigit() else 0
        if end <= at or data[end - 1 : end] != RECORD_END:
            found = data.find(RECORD_END, at)
            end = found + 1 if found >= 0 else len(data)
        yield at, end
        at = end


def row_of(name: str, number: int, data: bytes) -> tuple:
    found = decode(data)
    leader, fields = found or (data[:24].decode("latin-1"), [])
    return name, number, leader, [(f["pos"], f["tag"], f["ind1"], f["ind2"], f["data"], [(s["code"], s["value"]) for s in f["subfields"]]) for f in fields], found is None


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, number: int):
        super().__init__((path, start, end, number))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.paths = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]

    def partitions(self) -> list[InputPartition]:
        stretches = [(path, at) for path in self.paths for at in range(0, os.path.getsize(path), SPLIT_BYTES)]
        return [_Part(path, at, at + SPLIT_BYTES, i) for i, (path, at) in enumerate(stretches)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, start, end, number = partition.value
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            if start:  # behind the first record end at or before which a record of the stretch before ends
                found = data.find(RECORD_END, start - 1)
                start = found + 1 if found >= 0 else len(data)
            for i, (at, upto) in enumerate(_lengths(data, start)):
                if at >= end:
                    break
                yield row_of(path, (number << PLACE_BITS) + i, data[at:upto])


def numbered(records: DataFrame) -> DataFrame:
    """Records with dense numbers from 0 on: the stretches' counts, one row each, give each stretch its first number."""
    stretch = F.shiftright("record_index", PLACE_BITS)
    counts = records.groupBy(stretch.alias("stretch")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("stretch", before.alias("first"))
    rows = records.withColumn("stretch", stretch).join(firsts, "stretch")
    return rows.withColumn("record_index", F.col("first") + F.col("record_index").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).select(*records.columns)


class _Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    """One file for each task, under a name of its own until the job commits; files of other jobs keep theirs."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:8]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        c = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        part = os.path.join(self.path, f".part-{c.partitionId():05d}-{c.taskAttemptId()}.mrc")
        with open(part, "wb") as f:
            for r in rows:
                f.write(encode(r["leader"], [{**x.asDict(), "subfields": [s.asDict() for s in x["subfields"]]} for x in r["fields"]]))
        return _Done(part)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "part-*.mrc")):
                os.remove(old)
        for m in messages:
            folder, name = os.path.split(m.path)
            os.replace(m.path, os.path.join(folder, f"{name[1:11]}-{self.job}.mrc"))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class MarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marc2709"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Statements of a text corpus: line, section, text, times, status, defect.

    One statement on a line; # begins a comment, [section: x] a section, and a trailing # [xN] status:Dn annotates.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    head = F.nullif(F.regexp_extract("value", r"^\[section:\s*(.*?)\s*\]$", 1), F.lit(""))
    # the section above a line, in its own file: corpora are files that a person reads
    rows = lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    note = F.regexp_extract("value", r"#\s*(.*)$", 1)
    kept = rows.where("value <> '' AND NOT startswith(value, '#')").where(~F.col("value").rlike(r"^\[section:"))
    return kept.select("line", "section", F.trim(F.regexp_replace("value", r"\s+#.*$", "")).alias("text"), F.coalesce(F.regexp_extract(note, r"\[x(\d+)\]", 1).try_cast("int"), F.lit(1)).alias("times"), F.regexp_extract(note, r"(loss|fail|warn|known)", 1).alias("status"), F.regexp_extract(note, r":(D\d+)", 1).alias("defect"))


def statement_scan(spark: SparkSession, path: str) -> DataFrame:
    """place and text of all statements of MARC files (by their control number or place) or of a text corpus (by line)."""
    if not path.lower().endswith((".mrc", ".marc", ".dat")):
        return corpus(spark, path).select(F.concat(F.lit("line "), F.col("line") + 1).alias("place"), "text")
    from seriate.operators import records

    spark.dataSource.register(MarcSource)
    found = numbered(spark.read.format("marc2709").load(path))
    place = F.coalesce(F.nullif(F.trim(records.first_value("001", None)), F.lit("")), F.concat(F.lit("record "), F.col("record_index") + 1))
    return records.statements(found).join(found.select("record_index", place.alias("place")), "record_index").select("place", "text")
