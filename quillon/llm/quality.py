"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are hashed words, word shapes (classes of the first and last characters) and repetitions of words, in
`TERMS` buckets. Document frequencies come from all documents. Term weights (log frequency times inverse document
frequency) of a bounded labelled sample are factored; its leading `LATENT` directions are the space. The sample's vectors
are broadcast; every document's cosines with all of them are computed exactly, block by block, and the `NEIGHBOURS`
nearest vote with their labels, weighted by similarity.

Defined results: null and empty texts have no terms, lie at no angle to anything, and get the sample's share of label 1;
so does everything without labelled rows (0.5 if there are none at all); repeated rows score alike; other columns aren't
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: Labelled rows that a fit reads at most, picked by a hash of doc_id.
FIT_ROWS = 2_000
WORDS, SHAPES = 1_536, 512
TERMS = WORDS + SHAPES
LATENT = 48
NEIGHBOURS = 15

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x80:] = 4


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the terms of each document (documents x TERMS)."""
    docs = len(offsets) - 1
    starts, ends, first = common.spans_of(data, offsets, "space")
    if not len(starts):
        return np.zeros((docs, TERMS), np.float32)
    h = common.hashed(common._LOWER[data], starts, ends)
    owner = np.repeat(np.arange(docs), np.diff(first))
    shape = (_CLASS[data[starts]] * np.uint64(65_536) + _CLASS[data[np.maximum(ends - 2, starts)]] * np.uint64(256) + _CLASS[data[ends - 1]]) * np.uint64(4)
    shape += (np.minimum(ends - starts, 24) // 8).astype(np.uint64)
    columns = [(h % np.uint64(WORDS)).astype(np.int64), WORDS + 8 + (common.mix(shape) % np.uint64(SHAPES - 8)).astype(np.int64)]
    owners = [owner, owner]
    for back in (1, 2, 3):
        same = np.flatnonzero((h[back:] == h[:-back]) & (owner[back:] == owner[:-back]))
        columns.append(np.full(len(same), WORDS + back, np.int64))
        owners.append(owner[same])
    flat = np.concatenate(owners) * TERMS + np.concatenate(columns)
    return np.bincount(flat, minlength=docs * TERMS).reshape(docs, TERMS).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights: words and shapes each of length 1, then both together."""
    x = np.log1p(counts) * idf
    out = np.empty_like(x)
    for a, b in ((0, WORDS), (WORDS, TERMS)):
        norm = np.sqrt((x[:, a:b] ** 2).sum(axis=1, keepdims=True))
        out[:, a:b] = x[:, a:b] / np.maximum(norm, 1e-12)
    return out


def _frequencies(batches):
    total = np.zeros(TERMS, np.int64)
    n = 0
    for rows, data, offsets in common.steps(batches):
        total += (terms(data, offsets) > 0).sum(axis=0)
        n += rows.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(range(TERMS + 1), pa.int32()), pa.array([*total.tolist(), n], pa.int64())], names=["term", "n"])


class Space:
    """The latent space with its labelled vectors."""

    def __init__(self, idf: np.ndarray, counts: np.ndarray, labels: np.ndarray):
        self.idf, self.labels = idf, labels
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.axes = np.zeros((TERMS, 0), np.float32)
        if len(labels):
            x = weighted(counts, idf)
            values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
            take = min(LATENT, int((values > 1e-6 * max(values[-1], 1e-12)).sum()))
            self.axes = vectors[:, ::-1][:, :take].astype(np.float32)
        self.points = self.place(counts) if len(labels) else np.zeros((0, 0), np.float32)

    def place(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.idf) @ self.axes
        return z / np.maximum(np.sqrt((z**2).sum(axis=1, keepdims=True)), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.share)
        there = counts.any(axis=1)
        if not len(self.labels) or not there.any():
            return out
        near = self.place(counts[there]) @ self.points.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** 4 + 1e-9
        out[there] = (vote * self.labels[best]).sum(axis=1) / vote.sum(axis=1)
        return out


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Space:
    """A space from the frequencies of all documents and at most `rows` labelled ones (see common.train_rows)."""
    counted = docs.select("text").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 rows
    found = np.zeros(TERMS + 1)
    for r in counted:
        found[r["term"]] = r["n"]
    idf = np.log((1 + found[-1]) / (1 + found[:-1])).astype(np.float32) + np.float32(0.3)

    def run(batches):
        for sample, data, offsets in common.steps(batches):
            counts = terms(data, offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([sample.column(0).cast(pa.int64()), pa.array([c.tobytes() for c in counts], pa.binary()), sample.column(2)], names=["doc_id", "counts", "label"])

    train = common.train_rows(docs, labels, "quality", rows).mapInArrow(run, "doc_id long, counts binary, label int")
    sample = sorted(train.collect(), key=lambda r: (r["doc_id"], bytes(r["counts"])))  # FIT_ROWS rows of 8 kB at most
    counts = np.array([np.frombuffer(r["counts"], np.int32) for r in sample], np.float32).reshape(len(sample), TERMS)
    return Space(idf, counts, np.array([float(r["label"] > 0) for r in sample]))


def scores(docs: DataFrame, space: Space) -> DataFrame:
    """Per document: doc_id and score."""
    shared = docs.sparkSession.sparkContext.broadcast(space)  # FIT_ROWS x LATENT and TERMS x LATENT floats

    def run(batches):
        own = shared.value
        for rows, data, offsets in common.steps(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(own.scores(terms(data, offsets)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = scores(docs, learn(docs, common.read(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
