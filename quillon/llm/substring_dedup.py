"""Substring dedup by counting content-defined blocks and windows over the corpus itself.

The reference is the corpus, cut into blocks where its content says so: of each window of `window` words, the 8-gram with
the smallest hash is its anchor; the consecutive windows of one anchor are a block. Equal windows have equal anchors. An
index spread over the cluster by hash holds all blocks, by anchor and by the hash of the block's words. A document is
matched by counts, in place of a greedy parse: a block that occurs twice is matched as a whole, and its owner is the
smallest doc_id that holds it; of a block whose anchor recurs in other words, each window is looked up on its own (this
is the check at factor boundaries). Matches that follow each other without a gap and have one owner make a factor; a
factor is `window` words at least, and its words are a duplicate span. A window whose anchor occurs once can't repeat,
so nothing is lost.

Defined results: null and empty texts have no words and lose none; repeated rows are duplicates of each other; a window
that repeats within one document counts; documents shorter than the window keep everything. doc_id should be unique:
spans found for one doc_id apply to each row that has it. Rows of null doc_id are kept unjudged. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

WINDOW = 35
ANCHOR = 8
#: Entries (8 to 16 bytes) that may be broadcast to the scans; more go through a shuffled join.
BROADCAST_ENTRIES = 2_000_000

_BLOCK = "anchor long, content long, doc_id long, at int, n int"


def _first_least(x: np.ndarray, n: int) -> np.ndarray:
    """The index of the first smallest of x[i : i + n], for every i, by doubling."""
    if len(x) < n:
        return np.zeros(0, np.int64)
    best, have = np.arange(len(x)), 1

    def pick(a, b):
        return np.where(x[b] < x[a], b, a)

    while have * 2 <= n:
        best = pick(best[:-have], best[have:])
        have *= 2
    rest = n - have
    return pick(best[: len(x) - n + 1], best[rest : rest + len(x) - n + 1]) if rest else best


def blocks(h: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes h: each block's first window start and number of windows, its anchor and its content hash."""
    g = common.grams(h, k)
    anchor = _first_least(g, window - k + 1)
    last = np.repeat(first[1:], np.diff(first))[: len(anchor)] - window
    at = np.flatnonzero(np.arange(len(anchor)) <= last)
    if not len(at):
        return at, at, g[:0], g[:0]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    new[1:] |= np.isin(at[1:], first)
    begins = np.flatnonzero(new)
    n = np.diff(np.append(begins, len(at)))
    start = at[begins]
    own = anchor[start]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * common._power(common._BASE, len(h)), out=total[1:])
    content = (total[start + n + window - 1] - total[start]) * common._power(common._INVERSE, len(h) + 1)[start]
    return start, n, g[own], common.mix(content + (own - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64))


def _emit_blocks(window: int, k: int):
    def run(batches):
        for rows, data, offsets in common.steps(batches):
            h, first = common.words(data, offsets, "space", lower=False)
            start, n, anchor, content = blocks(h, first, window, k)
            doc = np.searchsorted(first, start, "right") - 1
            ids = rows.column(0).cast(pa.int64()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), ids, pa.array((start - first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["anchor", "content", "doc_id", "at", "n"],
            )

    return run


def _emit_windows(window: int):
    """The listed windows of each document, as two 64-bit hashes with document and position."""

    def run(batches):
        for rows, data, offsets in common.steps(batches):
            h, first = common.words(data, offsets, "space", lower=False)
            listed = rows.column(2)
            cuts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = listed.flatten()
            doc = np.repeat(np.arange(rows.num_rows), np.diff(cuts))
            at, n = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            if not len(at):
                continue
            good = first[doc] + at + n + window - 1 <= first[doc + 1]  # a text of the same doc_id may be another
            at, n, doc = at[good], n[good], doc[good]
            where = np.repeat(first[doc] + at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            doc = np.repeat(doc, n)
            low, high = common.grams(h, window, 1)[where], common.grams(h, window, 2)[where]
            ids = rows.column(0).cast(pa.int64()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), ids, pa.array((where - first[doc]).astype(np.int32))], names=["low", "high", "doc_id", "at"]
            )

    return run


def _joined(texts: DataFrame, lists: DataFrame, entries: int, how: str) -> DataFrame:
    """texts with the per-document lists; these are broadcast if their entries are counted to be few."""
    return texts.join(F.broadcast(lists) if entries <= BROADCAST_ENTRIES else lists, "doc_id", how)


def matches(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Repeated stretches of windows: (doc_id, at, n, owner), n windows from word at on."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    found = texts.mapInArrow(_emit_blocks(window, k), _BLOCK)
    again = common.stored(found.groupBy("anchor").agg(F.count("*").alias("all")).where("all > 1").select("anchor"), "anchors")  # stored: a join with it can then split hot anchors
    found = common.stored(found.join(again, "anchor"), "blocks")
    contents = found.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min("doc_id").alias("owner"))
    # of each block (anchor, content): how often it occurs; of each anchor: how many blocks share it
    contents = common.stored(contents, "contents")
    shared = contents.join(common.stored(contents.groupBy("anchor").agg(F.count("*").alias("contents")), "anchors"), "anchor")
    placed = common.stored(found.join(common.stored(shared, "shared"), ["anchor", "content"]).select("doc_id", "at", "n", "times", "contents", "owner"), "placed")
    whole = placed.where("times > 1").select("doc_id", "at", "n", "owner")
    # one holder of each block whose anchor has other blocks stands for it (its owner's first); windows of all others are settled
    partial = placed.where("contents > 1 and doc_id = owner").select("doc_id", "at", "n").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("listed"))
    partial = common.stored(partial, "partial")
    entries = partial.agg(F.coalesce(F.sum(F.size("listed") + 1), F.lit(0))).first()[0]
    windows = _joined(texts, partial, entries, "inner").select("doc_id", "text", "listed").mapInArrow(_emit_windows(window), "low long, high long, doc_id long, at int")
    windows = common.stored(windows, "windows")
    index = windows.groupBy("low", "high").agg(F.count("*").alias("times"), F.min("doc_id").alias("owner")).where("times > 1").select("low", "high", "owner")
    single = windows.join(index, ["low", "high"]).select("doc_id", "at", F.lit(1).alias("n"), "owner")
    return whole.union(single)


def parse(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Repeats of each document merged into factors by owner: (doc_id, starts, ends, owners) in words."""
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "owner"))).alias("listed"))

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten()
            if not len(flat):
                continue
            at, n, owner = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            cuts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))]).astype(np.int64)
            turn = np.ones(len(at), bool)  # another document or another owner
            turn[1:] = owner[1:] != owner[:-1]
            turn[cuts[:-1]] = True
            end = at + n
            reach = np.maximum.accumulate(np.cumsum(turn) << 32 | end) & 0xFFFFFFFF
            new = turn.copy()
            new[1:] |= at[1:] > reach[:-1]
            begins = np.flatnonzero(new)
            where = pa.array(np.searchsorted(begins, cuts), pa.int32())
            columns = ((at[begins], pa.int32()), (np.maximum.reduceat(end, begins) + window - 1, pa.int32()), (owner[begins], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(where, pa.array(x, t)) for x, t in columns]], names=["doc_id", "starts", "ends", "owners"])

    return listed.mapInArrow(run, "doc_id long, starts array<int>, ends array<int>, owners array<long>")


def spans(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Duplicate spans of the documents that have any: (doc_id, starts, ends, owners), in words of the input."""
    return common.stored(parse(matches(docs, window, k), window), "spans")


def cut(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and kept: the words that stay, joined by one space."""
    found = spans(docs, window, k).select("doc_id", "starts", "ends")
    entries = found.agg(F.coalesce(F.sum(F.size("starts") + 1), F.lit(0))).first()[0]
    joined = _joined(docs.select("doc_id", "text"), found, entries, "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(_cutter, "doc_id long, n_words long, n_removed long, kept string")


def _cutter(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            n_words, removed, kept = [], [], []
            for text, starts, ends in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                found = (text or "").encode().split()
                stay = found
                if starts:
                    mask = np.ones(len(found), bool)
                    for a, b in zip(starts, ends):
                        mask[a:b] = False
                    stay = [found[i] for i in np.flatnonzero(mask)]
                n_words.append(len(found))
                removed.append(len(found) - len(stay))
                kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut(common.read(spark, sf_dir, "documents"))
    return table.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
