"""Benchmark decontamination by a generalised suffix automaton over word hashes of the test items.

Every document is streamed through the automaton; the longest match that ends at each word is tracked. A match of
`window` words (or a whole shorter item) marks its words. `clean` cuts the marked spans and drops documents of which
more than `coverage` is marked.

Defined results: null and empty texts have no words and no hits; items without an id, text or words take no part; rows
of one item id count as one item; repeated documents are judged one by one; other columns are neither read nor changed.
A benchmark of several blocks marks what one block would: all blocks are matched on the whole texts before any is cut.
An empty benchmark leaves everything clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: Words of one item window.
WINDOW = 10
#: Bytes of item text in one automaton; a larger benchmark is matched block by block, each with its own pass.
BLOCK_BYTES = 4 << 20

SCHEMA = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"
SCHEMA_NAMES = ["doc_id", "n_words", "starts", "ends", "items"]


class Automaton:
    """Suffix automaton over the items' word hashes, joined by separators that no document holds."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        sequences = []
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            h, _ = common.words(data, np.array([0, len(data)]), "alnum", lower=True)
            if len(h):
                sequences.append((item, h.tolist()))
        self.vocabulary = np.unique(np.array([x for _, s in sequences for x in s], np.uint64))
        self.shortest = min((min(window, len(s)) for _, s in sequences), default=window)
        self.step, self.link, self.size = [{}], [-1], [0]
        ends: list[tuple[int, str, int]] = []  # (state of a prefix, item, words of the prefix)
        last = 0
        for k, (item, s) in enumerate(sequences):
            for n, x in enumerate(s, 1):
                last = self._add(last, x)
                ends.append((last, item, n))
            last = self._add(last, -1 - k)
        self.long = self._owners([(self._above(v, window), item) for v, item, n in ends if n >= window])
        whole = [(v, item, n) for (v, item, n), after in zip(ends, [*[e[2] for e in ends[1:]], 1]) if after == 1 and n < window]
        self.short: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        for n in sorted({n for _, _, n in whole}):
            for v, names in self._owners([(self._above(v, n), item) for v, item, m in whole if m == n]).items():
                self.short.setdefault(v, []).append((n, names))
        self.at_window: dict[int, int] = {}
        self.at_short: dict[int, list[tuple[int, tuple[str, ...]]]] = {}

    @staticmethod
    def _owners(pairs: list[tuple[int, str]]) -> dict[int, tuple[str, ...]]:
        found: dict[int, set[str]] = {}
        for v, item in pairs:
            found.setdefault(v, set()).add(item)
        return {v: tuple(sorted(names)) for v, names in found.items()}

    def _add(self, last: int, x: int) -> int:
        step, link, size = self.step, self.link, self.size
        cur = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = cur
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur

    def _above(self, v: int, n: int) -> int:
        """The state of the last n words of what v stands for."""
        while self.size[self.link[v]] >= n:
            v = self.link[v]
        return v

    def _shorter(self, v: int) -> list[tuple[int, tuple[str, ...]]]:
        found, u = [], v
        while u > 0:
            found += self.short.get(u, [])
            u = self.link[u]
        return found

    def match(self, run: list[int]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(end, words, items) of every window that ends in the run."""
        v = n = 0
        step, link, size = self.step, self.link, self.size
        for i, x in enumerate(run, 1):
            while v and x not in step[v]:
                v = link[v]
                n = size[v]
            if x in step[v]:
                v = step[v][x]
                n += 1
            if n >= self.window:
                u = self.at_window.get(v)
                if u is None:
                    u = self.at_window[v] = self._above(v, self.window)
                yield i, self.window, self.long[u]
            if self.short and v:
                shorter = self.at_short.get(v)
                if shorter is None:
                    shorter = self.at_short[v] = self._shorter(v)
                for k, names in shorter:
                    if k <= n:
                        yield i, k, names

    def scan(self, h: np.ndarray, first: np.ndarray) -> list[tuple[list[int], list[int], list[str]]]:
        """Per document, merged marked spans (word indices) and the items found."""
        docs = len(first) - 1
        found: list[tuple[list[int], list[int], list[str]]] = [([], [], []) for _ in range(docs)]
        if not len(h) or not len(self.vocabulary):
            return found
        at = np.searchsorted(self.vocabulary, h)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == h
        edge = np.zeros(len(h) + 1, bool)
        edge[first] = True
        edge[1:-1] |= known[1:] != known[:-1]
        edge[0] = edge[-1] = True
        cuts = np.flatnonzero(edge)
        lengths = np.diff(cuts)
        keep = known[cuts[:-1]] & (lengths >= self.shortest)
        for begin, length in zip(cuts[:-1][keep].tolist(), lengths[keep].tolist()):
            spans: list[tuple[int, int]] = []
            items: set[str] = set()
            for end, k, names in self.match(h[begin : begin + length].tolist()):
                spans.append((begin + end - k, begin + end))
                items.update(names)
            if not spans:
                continue
            d = int(np.searchsorted(first, begin, "right")) - 1
            starts, ends, have = found[d]
            for a, b in sorted(spans):
                a, b = a - int(first[d]), b - int(first[d])
                if ends and a <= ends[-1]:
                    ends[-1] = max(ends[-1], b)
                else:
                    starts.append(a)
                    ends.append(b)
            have.extend(items)
        return [(s, e, sorted(set(i))) for s, e, i in found]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about block_bytes of text, streamed to the driver one after another."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    block, held = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        if block and held + len(row[1]) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    yield block


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, marked word spans (starts, ends), and the ids of items with occurring windows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _marked(rows, benchmark, window, block_bytes, lambda batches: (batch.select(SCHEMA_NAMES) for batch in batches), SCHEMA)


def marked(starts: list[int], ends: list[int]) -> int:
    """Words in the union of spans that may overlap."""
    total, reach = 0, 0
    for a, b in sorted(zip(starts, ends)):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of a hits table."""
    spans = F.array_sort(F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b")))
    reach = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0).cast("long"), s.b - F.greatest(s.a.cast("long"), acc.reach))).alias("n"), F.greatest(acc.reach, s.b.cast("long")).alias("reach")),
        lambda acc: acc.n,
    )
    table = found.withColumn("n_hit", reach)
    return table.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with all marked spans cut from the texts; documents marked over more than `coverage` of their words go.

    Columns stay as they are but for text (and n_chars, where there is one, which follows the text)."""
    names = docs.columns
    rest = [c for c in names if c != "text"]
    inner = docs.select("text", F.struct(*rest).alias("rest") if rest else F.lit(None).cast("string").alias("rest"))
    cut = _marked(inner, benchmark, window, block_bytes, _cutter(coverage), inner.schema)
    out = cut.select("text", *([F.col("rest")[c].alias(c) for c in rest]))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def _marked(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, finish, schema) -> DataFrame:
    """What finish makes of rows (text and others) with n_words, starts, ends and items.

    Each block's pass adds to what those before it found on the same texts; the last one also finishes."""
    spark = rows.sparkSession
    out = rows.select("*", F.lit(0).cast("long").alias("n_words"), *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("starts", "int"), ("ends", "int"), ("items", "string"))])
    blocks = _blocks(benchmark, block_bytes)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast((block, window))  # at most block_bytes and one item
        out = out.mapInArrow(common.frugal(_marker(shared, None if after else finish)), out.schema if after else schema)
        block = after
    return out


def _union(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The union of spans, merged where they meet."""
    first, last = [], []
    for a, b in sorted(zip(starts, ends)):
        if last and a <= last[-1]:
            last[-1] = max(last[-1], b)
        else:
            first.append(a)
            last.append(b)
    return first, last


def _marker(shared, finish=None):
    def mark(batches):
        automaton = Automaton(*shared.value)
        for rows, data, offsets in common.steps(batches):
            h, first = common.words(data, offsets, "alnum", lower=True)
            found = automaton.scan(h, first)
            at = rows.schema.get_field_index("n_words")
            had = zip(*(rows.column(at + i).to_pylist() for i in (1, 2, 3)))
            spans, items = [], []
            for (a, b, have), (x, y, names) in zip(found, had):
                spans.append(_union(x + a, y + b))
                items.append(sorted({*names, *have}))
            columns = [pa.array(np.diff(first)), pa.array([a for a, _ in spans]), pa.array([b for _, b in spans]), pa.array(items)]
            types = rows.schema.types[at:]
            yield pa.RecordBatch.from_arrays([*rows.columns[:at], *[c.cast(t) for c, t in zip(columns, types)]], schema=rows.schema)

    return (lambda batches: finish(mark(batches))) if finish else mark


def _cutter(coverage: float):
    def run(batches):
        for rows, data, offsets in common.steps(batches):
            at, marks = rows.schema.get_field_index("text"), rows.schema.get_field_index("n_words")
            counts, spans = rows.column(marks).to_pylist(), list(zip(rows.column(marks + 1).to_pylist(), rows.column(marks + 2).to_pylist()))
            rows = rows.select(rows.schema.names[:marks])
            if any(a for a, _ in spans):
                starts, ends, first = common.spans_of(common._LOWER[data], offsets, "alnum")
                texts, keep = rows.column(at).to_pylist(), [True] * rows.num_rows
                for d, (a, b) in enumerate(spans):
                    if not a:
                        continue
                    keep[d] = sum(b) - sum(a) <= coverage * counts[d]
                    body, parts, done = data[offsets[d] : offsets[d + 1]].tobytes(), [], 0
                    for s, e in zip(a, b):
                        parts.append(body[done : starts[first[d] + s] - offsets[d]])
                        done = ends[first[d] + e - 1] - offsets[d]
                    parts.append(body[done:])
                    texts[d] = b"".join(parts).decode()
                rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type)).filter(pa.array(keep))
            if rows.num_rows:
                yield rows

    return run


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(hits(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")))
