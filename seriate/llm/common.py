"""Shared helpers: tables, the shared folder, words and fixed-size bitmaps."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import json
import mmap
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriate.operators import code

#: A word of the contracts: a run of characters outside space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _released() -> None:
    """Give memory that a task no longer needs back to the system: idle workers stay, and share the executor's limit."""
    _OPEN.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def _tidy(function):
    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            _released()

    return run


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow, with this package's code on the executors; tasks give their memory back as they end."""
    return code.arrow_map(df, _tidy(function), schema)


@lru_cache(maxsize=1)
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="seriate-shared-")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_root()


#: Working tables made since each open working() began.
_WORKING: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/seriate-llm/{name}-{uuid.uuid4().hex[:12]}"
    if _WORKING:
        _WORKING[-1].append(path)
    return path


@contextlib.contextmanager
def working(spark: SparkSession):
    """Deletes at its end the working tables that were made in it: what is to stay must be written elsewhere by then."""
    _WORKING.append([])
    try:
        yield
    finally:
        dropped(spark, *_WORKING.pop())


#: Bytes of a batch on its way to a worker and back: Spark's own 64 MB is held several times over in each.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str, path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    with _small_batches(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete working tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def saved(uri: str, arrays: list[np.ndarray]) -> None:
    """A file of arrays, each at a multiple of 64 bytes; a retried task replaces it by the same."""
    head, at, parts = [], 0, []
    for a in arrays:
        data = np.ascontiguousarray(a).tobytes()
        head.append([a.dtype.str, len(a), at])
        parts.append(data + bytes(-len(data) % 64))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    fs, path = pa.fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(part) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for p in parts:
            f.write(p)
    fs.move(part, path)


_OPEN: dict[str, list[np.ndarray]] = {}


def mapped(uri: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory until the task ends; from a store without local paths, of a copy in an unnamed file."""
    if uri not in _OPEN:
        fs, path = pa.fs.FileSystem.from_uri(uri)
        if fs.type_name == "local":
            f = open(path, "rb")
        else:
            f = tempfile.TemporaryFile()
            with fs.open_input_stream(path) as source:
                while block := source.read(1 << 24):
                    f.write(block)
            f.flush()
        with f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        size = int.from_bytes(data[:8], "little")
        _OPEN[uri] = [np.frombuffer(data, np.dtype(kind), n, 8 + size + at) for kind, n, at in json.loads(data[8 : 8 + size])]
    return _OPEN[uri]


def with_hint(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df only if a count shows that it has at most so many rows; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= rows else df


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if x is None else x for x in pc.cast(column, pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def buckets_for(df: DataFrame, each: int, least: int = 64, most: int = 1 << 16) -> int:
    """A power of two: so many buckets that each gets about `each` bytes of df, by Spark's own estimate of its size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(most, max(least, 1 << (max(1, size // each) - 1).bit_length())))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that any bits of a hash can be used on their own."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(a: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of k consecutive values, modulo 2^64."""
    n = len(a) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b = [pow(base, i, 1 << 64) for i in range(k + 1)]
    out = np.zeros(n, np.uint64)
    pos, size, block, left = 0, 1, a, k  # block: hashes of runs of size values, doubled each time
    while left:
        if left & 1:
            out = out * np.uint64(b[size]) + block[pos : pos + n]
            pos += size
        left >>= 1
        if left:
            block = block[: len(block) - size] * np.uint64(b[size]) + block[size:]
            size *= 2
    return out


#: Bytes that are hashed at once, and the longest stretch that is hashed so; a longer one is hashed by XXH64.
_STEP, _LONG = 1 << 18, 64
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def of(base: int) -> np.ndarray:
        out = np.full(_STEP + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, which follow on one another and don't overlap.

    A hash is a polynomial in the bytes' codes, mixed with their number: sums over all of the data give those of
    all stretches at once.
    """
    out, size, (up, down) = np.empty(len(starts), np.uint64), ends - starts, _powers()
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _STEP, "right")))
        if ends[i] - a <= _STEP:
            n = int(ends[j - 1] - a)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_LETTERS[data[a : a + n]] * up[:n], out=sums[1:])
            s = starts[i:j] - a
            out[i:j] = (sums[ends[i:j] - a] - sums[s]) * down[s]
        i = j
    out = mixed(out + size.astype(np.uint64) * np.uint64(_BASE))
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACES[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = edge if space[0] else np.r_[0, edge]
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return stretch_hashes(data, starts, ends), np.diff(np.r_[0, np.searchsorted(starts, bounds)])


def text_slices(texts: list[bytes], most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about so many bytes; a longer text is a range of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def squeezed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers as planes of bytes in one zstandard frame: sorted and small numbers take little room."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes)


def unsqueezed(blob: bytes, kinds: list) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(planes) // sum(widths), 0, []
    for kind, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(planes[at : at + n * w].reshape(w, n).T).view(kind).reshape(n))
        at += n * w
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences; np.cumsum gives them back."""
    return np.diff(a, prepend=a.dtype.type(0)) if len(a) else a


def sums_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of values of each."""
    if not len(keys):
        return keys, values
    o = np.argsort(keys, kind="stable")
    k = keys[o]
    st = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[st], np.add.reduceat(values[o], st)


def blob_batches(buckets: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """One Arrow row for each bucket that has values: the bucket, and the columns' values as planes of bytes."""
    o = np.argsort(buckets.astype(np.uint16) if n <= 1 << 16 else buckets, kind="stable")
    b = buckets[o]
    st = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, np.int64)
    blobs = [squeezed([c[o[i:j]] for c in columns]) for i, j in zip(st, np.r_[st[1:], len(b)].astype(np.int64), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(b[st].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "values"])


def by_bucket(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each bucket of a task."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for bucket, blob in zip(b["bucket"].to_pylist(), b[column].to_pylist(), strict=True):
            held.setdefault(bucket, []).append(blob)
    for bucket in sorted(held):
        yield bucket, held.pop(bucket)


def together(blobs: list[bytes], kinds: list) -> list[np.ndarray]:
    """The columns of several blobs, one after the other."""
    parts = [unsqueezed(b, kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]


class Bitmap:
    """A Bloom filter of a fixed number of bits, cut into slices by the top bits of the key.

    Its size never depends on the data: a fuller filter lets more pass, and what passes is checked exactly
    later, so no case is lost. Each slice is made by the one task that holds all keys of its bucket; the number of
    slices, a power of two, grows with the data.
    """

    def __init__(self, slices: int = 256, bits: int = 1 << 28):
        self.slices, self.bits = slices, bits
        self.shift, self.each = np.uint64(65 - slices.bit_length()), max(8, bits // slices)

    def slice_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64)

    def positions(self, keys: np.ndarray, probes: int) -> list[np.ndarray]:
        """Bit positions in the key's own slice."""
        per = np.uint64(self.each - 1)
        a, b = keys & np.uint64(0xFFFFFFFF), ((keys >> np.uint64(24)) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        return [(a + np.uint64(i) * b) & per for i in range(probes)]

    def made(self, keys: np.ndarray, probes: int) -> bytes:
        """The slice with these keys, which all belong to it."""
        flat = np.zeros(self.each, np.uint8)
        for p in self.positions(keys, probes):
            flat[p] = 1
        return np.packbits(flat, bitorder="little").tobytes()

    def whole(self, slices: dict[int, bytes]) -> bytes:
        empty = bytes(self.each // 8)
        return b"".join(slices.get(i, empty) for i in range(self.slices))

    def has(self, array: np.ndarray, keys: np.ndarray, probes: int) -> np.ndarray:
        base = self.slice_of(keys) * (self.each // 8)
        ok = np.ones(len(keys), bool)
        for p in self.positions(keys, probes):
            ok &= (array[base + (p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok
