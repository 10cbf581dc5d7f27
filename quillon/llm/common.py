"""Shared pieces of the corpus operators: table reading, durable intermediate tables, and word hashing of Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; longer single documents form a step of their own.
STEP_BYTES = 1 << 20
#: Rows that go to a Python worker at once while an intermediate table is written: texts and sets are long rows.
BATCH_ROWS = 1_000

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes outside words of the alphanumeric kind: 00-2F, 3A-60, 7B-7F (after lower-casing A-Z).
_PUNCT = np.zeros(256, bool)
_PUNCT[0x00:0x30] = _PUNCT[0x3A:0x61] = _PUNCT[0x7B:0x80] = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where a local session lacks the setting, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a Python worker gives the memory that it no longer uses back: workers outlive tasks and stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about `limit` bytes of text: (rows, bytes, offsets); null texts count as empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.zeros(len(column) + 1, np.int64)
        if len(column):
            lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0)
            np.cumsum(lengths.to_numpy(zero_copy_only=False), out=sizes[1:])
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
            part = pa.compute.fill_null(column.slice(at, end - at), b"")
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            body = part.buffers()[2]
            data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            yield batch.slice(at, end - at), data, offsets - offsets[0]
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


def spans_of(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words and, per document, the index of its first word (one entry more than documents).

    kind: "space" (words between ASCII white space) or "alnum" (ASCII digits, a-z and all non-ASCII)."""
    gap = (_GAP if kind == "space" else _PUNCT)[data]
    inside = ~gap
    first, last = inside.copy(), inside.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    begins, stops = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[begins] = inside[begins]
    last[stops] = inside[stops]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same on every machine."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, kind: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in order, and each document's first word."""
    if lower:
        data = _LOWER[data]
    starts, ends, first = spans_of(data, offsets, kind)
    return hashed(data, starts, ends), first


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of n words (len(h) - n + 1 of them); runs over a document's end are the caller's to drop."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base = (0xA24BAED4963EE407 + 2 * salt) % (1 << 64) | 1
    size = len(h) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= np.uint64(base)
        out += h[i : i + size]
    return mix(out + np.uint64(salt))


def hex_sha(text: str | bytes) -> str:
    import hashlib

    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def train_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most `bound` labelled rows whose crc32(doc_id as text) mod 5 isn't 0, in an order that a hash of doc_id fixes: (doc_id, text, label).

    Rows with a null label or null doc_id don't take part; of several labels for a document the largest counts, of
    several texts the one of the smallest hash."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return one_text(docs, picked.select("doc_id")).join(F.broadcast(picked), "doc_id")


def one_text(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, text), one row for each of a bounded table of ids: of several texts the one of the smallest hash."""
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id")
    least = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return least.select("doc_id", F.col("least.text").alias("text"))


def held_out() -> "F.Column":
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
