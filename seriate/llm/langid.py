"""Language identification by compression.

For each language a zstandard compressor gets raw text of that language as its dictionary. A text (in lower case,
each run of anything but letters as one space) is encoded with each of them, in pieces so that the dictionary
counts all through a long text, and the language with the smallest sum of sizes wins. If the runner-up comes
within MARGIN of it, the text is rejected.

Learning takes at most DOCS_PER_LANG rows of each language (the least hash in each of as many hash buckets), of
each of them PIECES pieces spread over the whole text, and DICT_BYTES bytes in all. Texts that learning rows hold
under several languages tell nothing and are left out. All languages get dictionaries of the same size, that of the
smallest (but LEAST_BYTES at least), as a larger one costs longer offsets. Prediction reads whole texts.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; if no language was
learned, every text is; of languages that tie the first by name is given and the text is rejected; rows with a null
doc_id are never learned from and are held out if the empty string's checksum says so; repeated rows stay, and rows
with the same doc_id are told apart by their texts; only doc_id, text and (for learning) lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriate.llm.common import arrow_map, stored, texts_of, with_hint

DOCS_PER_LANG = 128
PIECES, PIECE_CHARS = 4, 1024
DICT_BYTES, LEAST_BYTES = 1 << 17, 4096
#: A sample of so many rows is broadcast.
SAMPLE = DOCS_PER_LANG * 256
PIECE = 4096
LEVEL = 5
MARGIN = 0.002
NONE = "und"
_OTHER = re.compile(r"[\W\d_]+")
_RESULT = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).cast("binary")) % 5


def _pieces(text: Column) -> Column:
    """The whole of a short text, or PIECES pieces spread evenly over a long one."""
    spread = [F.substring(text, (F.lit(1) + F.floor((F.length(text) - PIECE_CHARS) * F.lit(i) / F.lit(PIECES - 1))).cast("int"), F.lit(PIECE_CHARS)) for i in range(PIECES)]
    return F.when(F.length(text) <= PIECES * PIECE_CHARS, text).otherwise(F.concat_ws("\n", *spread))


def learned(docs: DataFrame) -> dict[str, bytes]:
    """Raw dictionary text for each language, from the rows that are not held out."""
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(doc, text).alias("h"), F.xxhash64(text).alias("t"), text.alias("text"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(DOCS_PER_LANG)).alias("b")).agg(F.min(F.struct("h", "t", _pieces(F.col("text")).alias("text"))).alias("x"))
    sample = stored(least.select("lang", "x.h", "x.t", "x.text"), "langid-sample")
    chosen = with_hint(sample.select("t").distinct(), SAMPLE)
    several = rows.select("lang", "t").join(chosen, "t", "left_semi").groupBy("t").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).where("a <> b")
    texts: dict[str, list[bytes]] = {}
    for r in sample.join(several, "t", "left_anti").orderBy("lang", "h", "text").collect():
        texts.setdefault(r["lang"], []).append(letters(r["text"]))
    whole = {lang: sum(map(len, parts)) + len(parts) - 1 for lang, parts in texts.items()}
    size = min(DICT_BYTES, max(LEAST_BYTES, min(whole.values(), default=0)))
    made = {lang: _shared(parts, size) for lang, parts in sorted(texts.items())}
    cut = max(LEAST_BYTES, min(map(len, made.values()), default=0))  # shares are rounded down
    return {lang: raw[:cut] for lang, raw in made.items() if len(raw) >= 8}


def _shared(parts: list[bytes], size: int) -> bytes:
    """Parts of at most size bytes together: the longest give way first."""
    low, high = 1, size
    while low < high:  # the greatest share that fits
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(mid, len(p)) + 1 for p in parts) - 1 <= size else (low, mid - 1)
    return b"\n".join(p[:low] for p in parts)[:size]


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], margin: float = MARGIN):
        self.langs, self.margin, self.packers = list(dictionaries), margin, []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = letters(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(p.compress(x)) for x in pieces) for p in self.packers]

    def __call__(self, text: str) -> tuple[str, float, float, bool]:
        """Language, score, margin over the runner-up as a share of its size, and whether it is rejected."""
        if not self.langs or not any(map(str.isalpha, text)):
            return NONE, 0.0, 0.0, True
        s = np.array(self.sizes(text), float)
        best = int(s.argmin())
        rest = np.delete(s, best)
        margin = float((rest.min() - s[best]) / rest.min()) if len(rest) else 1.0
        # of two texts with the same margin, the longer is the surer
        score = 1 / np.exp(-np.clip((s - s[best]) / (2 + s[best] / 50), 0, 50)).sum()
        return self.langs[best], float(score), margin, margin <= 0 or margin < self.margin


def _predicted(dictionaries: dict[str, bytes], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries, margin)
        for b in batches:
            got = [classify(t) for t in texts_of(b["text"])]
            lang, score, gap, rejected = ([x[i] for x in got] for i in range(4))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(rejected, pa.bool_())], [c.split()[0] for c in _RESULT.split(", ")])

    return run


def predict(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every row."""
    dictionaries = learned(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _predicted(dictionaries, margin), _RESULT)


def _kept(dictionaries: dict[str, bytes], margin: float, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries, margin)
        for b in batches:
            yield b.filter(pa.array([not classify(t)[3] for t in texts_of(b[column])], pa.bool_()))

    return run


def accepted(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return arrow_map(docs, _kept(learned(docs), margin, "text"), docs.schema)
