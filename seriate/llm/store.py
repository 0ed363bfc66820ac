"""A content-addressed store of token ids.

Writing: each document's ids (the end id included) are cut into chunks where a rolling hash of the last ids has
chosen bits zero, so equal passages give equal chunks wherever they stand. A chunk is named by its BLAKE2b
digest and stored once: the task that meets it first puts it into a block, digests alone are shuffled to find
chunks that several tasks have met, and a second pass over the blocks drops all but one of each. A document is
a recipe: its length, the digests of its chunks and their Merkle root. Recipes lie in files in ascending order of
doc_id, with the number of ids before each document; a manifest has for each file its first offset, its totals and
the Merkle root over its documents.

Reading: each segment (one file of recipes) asks once for each digest that it needs, and gets from each block the
chunks that it asked for, so a chunk that a third of all documents share travels once for each segment, not for
each document. Chunks are checked against their digests, documents and segments against their roots.

What goes to the tasks of a block (which chunks to drop, or who wants them) lies in files by part of the input, which
they map; so bodies are never shuffled to be joined with it.

The layout under one folder of the shared storage:
  objects         part, block, keys (digests, 16 bytes each), sizes (ids of each chunk, 16 bits), body: all of
                  their ids, low bytes and then high bytes, as one zstandard frame
  recipes/kind=0  seg, doc_id, local_start, n, digests, root;  recipes/kind=1  one row for each segment: totals and root
  manifest        seg, base, n, root

Defined results: a null text is empty and holds the end id alone; rows with a null doc_id come first; rows with
the same doc_id stay apart, in the order of their digests; an empty table gives an empty store; only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriate.llm.common import arrow_map, dropped, mapped, mixed, new_path, rolled, saved, stored, with_hint
from seriate.llm.tokens import encoder

END_ID = 2
#: Chunks hold at least LEAST ids and at most MOST; a cut comes every 512 ids or so beyond LEAST.
LEAST, MOST, EVERY, ROLL = 64, 4096, 512, 8
#: Ids of a segment, about.
SEGMENT = 4_000_000
#: Ids of a block, about.
BLOCK = 1 << 15
#: Parts of the input whose side files are one.
TOGETHER = 16
_BASE = 0x9E3779B97F4A7C15
_GEAR = mixed(np.arange(1, 65537, dtype=np.uint64) * np.uint64(_BASE))
_STAGED = "kind int, part int, block int, keys binary, sizes binary, body binary, doc_id long, n long"
_OBJECTS = "part int, block int, keys binary, sizes binary, body binary"
_SENT = "seg int, keys binary, sizes binary, body binary"
_RECIPES = "kind int, seg int, doc_id long, local_start long, n long, digests binary, root binary"
_RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, chunks int, root string"


def cuts(ids: np.ndarray, lengths: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of documents' ids, which follow on one another; one document if no lengths are given."""
    bounds = np.cumsum(lengths).tolist() if lengths is not None else [len(ids)]
    h = rolled(_GEAR[ids], ROLL, _BASE)
    marks = (np.flatnonzero((h >> np.uint64(40)) % np.uint64(EVERY) == 0) + ROLL).tolist()
    ends, first, m = [], 0, 0
    for n in bounds:
        last = first
        while m < len(marks) and marks[m] < n:
            c, m = marks[m], m + 1
            if c - first < ROLL:
                continue  # the hash reaches into the document before
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST:
                ends.append(c)
                last = c
        while n - last > MOST:
            last += MOST
            ends.append(last)
        if n > first:
            ends.append(n)
        first = n
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests; an odd one moves up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def packed(ids: np.ndarray) -> bytes:
    """Ids as two planes of bytes in one zstandard frame."""
    planes = np.ascontiguousarray(ids, "<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes)


def unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return np.ascontiguousarray(planes.reshape(2, -1).T).view("<u2").reshape(-1)


def _names(blob: bytes) -> list[bytes]:
    return [blob[i : i + 16] for i in range(0, len(blob), 16)]


def _chunked(path: str, end_id: int):
    """Blocks (kind 1) of the chunks that this task met first, and documents (kind 0) with their digests."""

    def block(part: int, number: int, held: list) -> pa.RecordBatch:
        keys, sizes = b"".join(x[0] for x in held), np.array([len(x[1]) for x in held], "<u2").tobytes()
        return pa.RecordBatch.from_pylist([{"kind": 1, "part": part, "block": number, "keys": keys, "sizes": sizes, "body": packed(np.concatenate([x[1] for x in held]))}], _schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, held, size, number = encoder(path).encode, set(), [], 0, 0
        part = TaskContext.get().partitionId()
        for whole in batches:
            for i in range(0, len(whole), 1024):
                b = whole.slice(i, 1024)
                ids, n = encode(b["text"], end_id)
                raw, bounds, docs, names, d, at = ids.tobytes(), np.cumsum(n).tolist(), [], [], 0, 0
                for c in cuts(ids, n):
                    name = digest(raw[2 * at : 2 * c])
                    names.append(name)
                    if name not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()  # what comes twice is dropped by the second pass
                        seen.add(name)
                        held.append((name, ids[at:c]))
                        size += c - at
                    at = c
                    if c == bounds[d]:
                        docs.append(b"".join(names))
                        names, d = [], d + 1
                    if size >= BLOCK:
                        yield block(part, number, held)
                        held, size, number = [], 0, number + 1
                held = [(k, x.copy()) for k, x in held]  # don't keep the batch
                none = pa.nulls(len(b), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int32)), pa.array(np.full(len(b), part, np.int32)), pa.nulls(len(b), pa.int32()), pa.array(docs, pa.binary()), none, none, b["doc_id"], pa.array(n)], schema=_schema)
        if held:
            yield block(part, number, held)

    _schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64())])
    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's digest and where it lies."""
    for b in batches:
        n = [len(k) // 16 for k in b["keys"].to_pylist()]
        keys = [x for k in b["keys"].to_pylist() for x in _names(k)]
        part, number = (np.repeat(b[c].to_numpy(), n).astype(np.int32) for c in ("part", "block"))
        at = np.concatenate([np.arange(x, dtype=np.int32) for x in n]) if n else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(part), pa.array(number), pa.array(at)], ["key", "part", "block", "at"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the places of equal chunks, which come in order, all but the first: the same ones if the task runs again."""
    last = None
    for b in batches:
        keep = []
        for key in b["key"].to_pylist():
            keep.append(key == last)
            last = key
        yield b.filter(pa.array(keep, pa.bool_()))


def _side_files(folder: str):
    """Writes rows of (part, block, seg, at), sorted, in one file for TOGETHER parts; gives the names of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b[c].to_numpy() for c in ("bucket", "part", "block", "seg", "at")] for b in batches]
        if got:
            rows = [np.concatenate(x) for x in zip(*got, strict=True)]
            o = np.lexsort(rows[::-1])
            rows = [x[o] for x in rows]
            names, first = np.unique(rows[0], return_index=True)
            for name, lo, hi in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(o)], strict=True):
                saved(f"{folder}/{name}", [x[lo:hi] for x in rows[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32))], ["bucket"])

    return run


def _sided(rows: DataFrame, folder: str) -> frozenset[int]:
    """Puts rows (part, block, seg, at) into side files, and returns which there are."""
    rows = rows.select(F.floor(F.col("part") / TOGETHER).cast("int").alias("bucket"), "part", "block", "seg", "at")
    return frozenset(r["bucket"] for r in arrow_map(rows.repartition("bucket"), _side_files(folder), "bucket int").collect())


def _beside(folder: str, have: frozenset[int], part: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """seg and at of a block's rows."""
    if part // TOGETHER not in have:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    parts, blocks, segs, at = mapped(f"{folder}/{part // TOGETHER}")
    lo, hi = np.searchsorted(parts, [part, part + 1])
    lo, hi = lo + np.searchsorted(blocks[lo:hi], [number, number + 1])
    return segs[lo:hi], at[lo:hi]


def _picked(keys: bytes, sizes: bytes, body: bytes, keep: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The chosen chunks of a block, as a block."""
    if keep.all():
        return keys, sizes, body
    n = np.frombuffer(sizes, "<u2")
    ids = unpacked(body)[np.repeat(keep, n)]
    return np.frombuffer(keys, "V16")[keep].tobytes(), n[keep].tobytes(), packed(ids)


def _swept(folder: str, have: frozenset[int]):
    """Blocks without the chunks that lie elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 64):
                out: list[tuple] = []
                for r in whole.slice(i, 64).to_pylist():
                    keep = np.ones(len(r["keys"]) // 16, bool)
                    keep[_beside(folder, have, r["part"], r["block"])[1]] = False
                    if keep.any():
                        out.append((r["part"], r["block"], *_picked(r["keys"], r["sizes"], r["body"], keep)))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], [c.split()[0] for c in _OBJECTS.split(", ")])

    return run


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the segment, the ids before each document in it, and the roots; one more row has the segment's totals."""
    seg, at, roots = TaskContext.get().partitionId(), 0, []
    for b in batches:
        n = b["n"].to_numpy()
        ends = at + np.cumsum(n)
        own = [merkle(_names(x)) for x in b["keys"].to_pylist()]
        roots += own
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), pa.array(np.full(len(n), seg, np.int32)), b["doc_id"], pa.array(ends - n, pa.int64()), b["n"], b["keys"], pa.array(own, pa.binary())], [c.split()[0] for c in _RECIPES.split(", ")])
        at = int(ends[-1]) if len(n) else at
    if roots:
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([seg], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([at], pa.int64()), pa.array([b""], pa.binary()), pa.array([merkle(roots)], pa.binary())], [c.split()[0] for c in _RECIPES.split(", ")])


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID) -> str:
    """Write the store of all documents' ids; returns its folder."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "store")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = stored(arrow_map(docs, _chunked(path, end_id), _STAGED), "", f"{folder}/staged", partition_by="kind")
    blocks = staged.where("kind = 1").select(*[c.split()[0] for c in _OBJECTS.split(", ")])
    places = arrow_map(blocks.select("part", "block", "keys"), _places, "key binary, part int, block int, at int")
    again = arrow_map(places.repartition("key").sortWithinPartitions("key", "part", "block", "at"), _later, "key binary, part int, block int, at int")
    have = _sided(again.withColumn("seg", F.lit(0)), f"{folder}/later")
    stored(arrow_map(blocks, _swept(f"{folder}/later", have), _OBJECTS), "", f"{folder}/objects")
    whole = staged.where("kind = 0").select("doc_id", "n", "keys")
    segments = max(1, -(-(whole.agg(F.sum("n")).first()[0] or 0) // SEGMENT))
    ordered = whole.repartitionByRange(segments, F.col("doc_id").asc_nulls_first(), F.col("keys")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("keys"))
    recipes = stored(arrow_map(ordered, _recipes, _RECIPES), "", f"{folder}/recipes", partition_by="kind")
    before = Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)  # one row for each segment
    stored(recipes.where("kind = 1").select("seg", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n", "root"), "", f"{folder}/manifest")
    dropped(spark, f"{folder}/staged", f"{folder}/later")
    return folder


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each digest once for each segment."""
    seen: set[tuple[int, bytes]] = set()
    for b in batches:
        new = []
        for seg, names in zip(b["seg"].to_pylist(), b["digests"].to_pylist(), strict=True):
            for i in range(0, len(names), 16):
                if (x := (seg, names[i : i + 16])) not in seen:
                    seen.add(x)
                    new.append(x)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.int32()), pa.array([x[1] for x in new], pa.binary())], ["seg", "key"])


def _sent(folder: str, have: frozenset[int]):
    """For each segment that wants chunks of a block, those chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 64):
                out: list[tuple] = []
                for r in whole.slice(i, 64).to_pylist():
                    segs, at = _beside(folder, have, r["part"], r["block"])
                    for seg in np.unique(segs).tolist():
                        keep = np.zeros(len(r["keys"]) // 16, bool)
                        keep[at[segs == seg]] = True
                        out.append((seg, *_picked(r["keys"], r["sizes"], r["body"], keep)))
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], [c.split()[0] for c in _SENT.split(", ")])

    return run


def _rebuilt(recipes: pa.Table, sent: pa.Table) -> pa.Table:
    parts: dict[bytes, np.ndarray] = {}
    for keys, sizes, body in zip(*(sent[c].to_pylist() for c in ("keys", "sizes", "body")), strict=True):
        ids, ends, names = unpacked(body), np.cumsum(np.frombuffer(sizes, "<u2"), dtype=np.int64), _names(keys)
        if len(ids) != ends[-1]:
            raise ValueError("a block doesn't match the sizes behind its digests")
        raw, first = ids.tobytes(), 0
        for name, end in zip(names, ends.tolist(), strict=True):
            if digest(raw[2 * first : 2 * end]) != name:
                raise ValueError(f"chunk {name.hex()} doesn't match its digest")
            parts[name] = ids[first:end]
            first = end
    recipes = recipes.sort_by("local_start")
    out: list[list] = [[] for _ in range(6)]
    roots = []
    for doc, start, base, n, names, root in zip(*(recipes[c].to_pylist() for c in ("doc_id", "local_start", "base", "n", "digests", "root")), strict=True):
        leaves = _names(names)
        ids = np.concatenate([parts[x] for x in leaves])
        if merkle(leaves) != root or len(ids) != n:
            raise ValueError(f"document {doc} doesn't match its recipe")
        roots.append(root)
        for o, v in zip(out, (doc, base + start, n, zlib.crc32(ids.astype("<u4")), len(leaves), root.hex()), strict=True):
            o.append(v)
    if merkle(roots) != recipes["seg_root"][0].as_py():
        raise ValueError("a segment doesn't match its manifest")
    return pa.Table.from_arrays([*(pa.array(o, pa.int64()) for o in out[:4]), pa.array(out[4], pa.int32()), pa.array(out[5], pa.string())], [c.split()[0] for c in _RESULT.split(", ")])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rebuild and verify every document: doc_id, start, n_tokens, ids_crc32, chunks, root."""
    recipes = spark.read.schema(_RECIPES).parquet(f"{folder}/recipes").where("kind = 0").drop("kind")
    manifest = with_hint(spark.read.parquet(f"{folder}/manifest").select("seg", "base", F.col("root").alias("seg_root")), 1_000_000)
    objects = spark.read.schema(_OBJECTS).parquet(f"{folder}/objects")
    wanted = arrow_map(recipes.select("seg", "digests"), _wanted, "seg int, key binary")
    places = arrow_map(objects.select("part", "block", "keys"), _places, "key binary, part int, block int, at int")
    side = new_path(spark, "store-wanted")
    have = _sided(wanted.join(places, "key").select("part", "block", "seg", "at"), side)
    sent = arrow_map(objects, _sent(side, have), _SENT)
    return recipes.join(manifest, "seg").groupBy("seg").cogroup(sent.groupBy("seg")).applyInArrow(_rebuilt, _RESULT)


def stored_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents' ids and read the files back."""
    return read(docs.sparkSession, write(docs, path, end_id=end_id))
