"""N-gram Jaccard join by universe-partition pigeonhole.

A document is the set of its distinct word 5-grams. Equal sets form a class first, so copies cost one row each and no
pairs. Sizes are banded; a scheme covers the pairs whose smaller set lies in one band, and fixes how many elements two
linked sets can differ by. Elements are hashed into m segments, u of which also get one-deletion neighbourhoods. Two sets
that differ by D elements then agree (or differ by one element, where neighbourhoods are kept) in segments of total
weight m + u - D at least; m and u are chosen by cost so that this exceeds the weight of the empty segments that a set
leaves out. A set with more empty segments than that leaves out none.

The index is laid out twice. The first layout covers all classes and only tells which of them share a signature with
another at all. For those, elements are counted: one that no other of them holds can't be shared, so a class with fewer
than 80 % shared elements has no link and goes. The second layout covers what is left, on the shared elements alone: its
own elements count as differences from the start, so two classes may differ by so much less elsewhere, and the segments
are fewer and more telling. Classes are dealt by the share of the allowed difference that their own elements use up
(`GRADES` grades), and each two grades have a layout of their own.

Candidates of a signature meet its smallest class, best-supported first; what isn't connected by verified links after
that is compared with every class of another component under the same signature. A pair is made only if the counts of
shared elements, and the parities of `PARITY` hash classes of elements (each element two sets differ by changes one
parity), allow a link. Verification is exact, on whole sets, so no link between components is lost.

Defined results: null and empty texts have empty sets and link with nothing; shorter texts than n words are one element,
their whole word sequence; repeated rows are one class; of rows with one doc_id and different texts each is judged by its
own text; null doc_id rows are returned with component null. Other columns aren't read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.components import components

N = 5
THRESHOLD = 80  # hundredths
#: Bands of set sizes grow by this factor; larger sets extend the bands.
BAND_GROWTH = 1.25
#: Grades of the share of the allowed difference that elements of one class alone use up.
GRADES = 8
#: Longs of 64 parities each.
PARITY = 8
#: Rows of ids that may be broadcast (16 bytes each); more go through a shuffled join.
BROADCAST_ROWS = 1_000_000


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """Sorted distinct element hashes per document."""
    h, first = common.words(data, offsets, "space", lower=True)
    g = common.grams(h, n)
    out = []
    short: dict[int, np.ndarray] = {}
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b == a:
            out.append(np.zeros(0, np.uint64))
        else:
            if b - a not in short:
                short[b - a] = common.grams(h, b - a, salt=b - a)
            out.append(short[b - a][a : a + 1])
    return out


def class_of(tokens: np.ndarray) -> int:
    """The class of a set: a hash of all its elements."""
    low, high = (int(common.mix(tokens ^ np.uint64(k)).sum(dtype=np.uint64)) for k in (0, 0x5BF03635))
    mixed = common.mix(np.array([low, high ^ len(tokens)], np.uint64))
    return int(common.mix(mixed[:1] + (mixed[1:] << np.uint64(1)))[0].view(np.int64))


class Layout:
    """Segments for pairs that differ by `differ` elements at most, in sets of about `low` to `mean` elements."""

    def __init__(self, differ: int, low: int, mean: float, salt: int):
        best = None
        for m in range(max(1, (differ + 1) // 2), differ + 2 + max(4, differ)):
            empty = m * (1 - 1 / m) ** low if m > 1 else 0.0
            c = math.ceil(empty + 3 * math.sqrt(empty))
            u = max(0, differ + 1 + c - m)
            if u > m:
                continue
            cost = differ + 1 + c + u * (mean / m - 1)
            if best is None or cost < best[0]:
                best = (cost, m, u, c)
        _, self.m, self.u, self.c = best
        self.mask = common.mix((np.arange(self.m, dtype=np.uint64) << np.uint64(32)) + np.uint64(salt))

    def signatures(self, tokens: np.ndarray, mixed: np.ndarray, differ: int) -> np.ndarray:
        """The signatures of a set whose partners differ by `differ` elements at most: it needs the first segments only."""
        m, u = self.m, self.u
        segment = ((tokens >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment, mixed)
        count = np.bincount(segment, minlength=m)
        used = max(u, min(m, differ + 1 + self.c - u))
        bare = np.count_nonzero(count[u:] == 0) + 2 * np.count_nonzero(count[:u] <= 1) > self.c  # neighbourhoods reach the empty signature from one element
        exact = common.mix(total[:used] ^ self.mask[:used])
        if not bare:
            exact = exact[count[:used] > 0]
        if not u:
            return exact
        near = segment < u
        less = common.mix((total[segment[near]] - mixed[near]) ^ self.mask[segment[near]])
        return np.concatenate([exact, less if bare else less[count[segment[near]] > 1]])


class Scheme:
    """The layouts for pairs whose smaller set has low..high elements."""

    def __init__(self, number: int, low: int, high: int, threshold: int):
        self.number, self.low, self.high, self.threshold = number, low, high, threshold
        self.top = high * 100 // threshold
        self.differ = self.most(high, self.top)
        self.all = Layout(self.differ, low, (low + self.top) / 2, number << 8)
        self.graded: dict[int, Layout | None] = {}

    def most(self, a: int, b: int) -> int:
        """Elements that linked sets of a and b elements can differ by."""
        return (a + b) * (100 - self.threshold) // (100 + self.threshold)

    def own(self, size: int) -> int:
        """Elements that a set of this size and a linked one of the scheme can differ by."""
        return self.most(size, max(min(size * 100 // self.threshold, self.top) if size <= self.high else 0, min(size, self.high)))

    def grade(self, alone: int) -> int:
        return alone * GRADES // (self.differ + 1)

    def least(self, grade: int) -> int:
        """Elements of one class alone that a grade means, at least."""
        return -(-grade * (self.differ + 1) // GRADES)

    def layout(self, one: int, other: int) -> Layout | None:
        """The layout of two grades; None if they leave no room for a link."""
        one, other = sorted((one, other))
        at = one * GRADES + other
        if at not in self.graded:
            left = self.differ - self.least(one) - self.least(other)
            low = max(1, -(-self.low * self.threshold // 100))
            self.graded[at] = Layout(left, low, (low + self.top) / 2, (self.number << 8) + at + 1) if left >= 0 else None
        return self.graded[at]

    def signatures(self, tokens: np.ndarray, mixed: np.ndarray, size: int) -> list[np.ndarray]:
        """Of the shared elements of a set of this size, in the layouts of all grades that may hold a linked set."""
        alone, out = size - len(tokens), []
        for other in range(GRADES):
            left = self.own(size) - alone - self.least(other)
            if left < 0:
                break
            found = self.layout(self.grade(alone), other)
            if found is not None:
                out.append(found.signatures(tokens, mixed, left))
        return out


class Schemes:
    def __init__(self, threshold: int = THRESHOLD):
        self.threshold, self.list = threshold, []

    def of(self, size: int) -> list[Scheme]:
        """All schemes that a set of this size takes part in."""
        while not self.list or self.list[-1].high < size:
            low = self.list[-1].high + 1 if self.list else 1
            self.list.append(Scheme(len(self.list), low, max(low, math.ceil(low * BAND_GROWTH) - 1), self.threshold))
        return [s for s in self.list if s.low <= size <= s.top]


def _emit_sets(n: int):
    def run(batches):
        for rows, data, offsets in common.steps(batches):
            found = sets_of(data, offsets, n)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([len(t) for t in found], pa.int64()), pa.array([class_of(t) for t in found], pa.int64())], names=["doc_id", "n_shingles", "class"])

    return run


def _pieces(keys: list[np.ndarray], owners: list[int], size: int = 200_000):
    """(key, class) rows in batches."""
    if keys:
        flat, own = np.concatenate(keys).view(np.int64), np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
        for at in range(0, len(flat), size):
            yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + size]), pa.array(own[at : at + size])], names=["key", "class"])


def _emit_signatures(n: int, threshold: int):
    """(key, class) in the layouts of all classes."""

    def run(batches):
        schemes = Schemes(threshold)
        for rows, data, offsets in common.steps(batches):
            found = [t for t in sets_of(data, offsets, n) if len(t)]
            keys, owners = [], []
            for tokens in found:
                mixed, own = common.mix(tokens), class_of(tokens)
                for s in schemes.of(len(tokens)):
                    keys.append(s.all.signatures(tokens, mixed, s.own(len(tokens))))
                    owners.append(own)
            yield from _pieces(keys, owners)

    return run


def _emit_elements(n: int):
    def run(batches):
        for rows, data, offsets in common.steps(batches):
            found = [t for t in sets_of(data, offsets, n) if len(t)]
            yield from _pieces(found, [class_of(t) for t in found])

    return run


def _emit_graded(threshold: int):
    """(key, class) in the layouts of grades, from (class, n, tokens)."""

    def run(batches):
        schemes = Schemes(threshold)
        for batch in batches:
            flat, sizes = batch.column(2).flatten().to_numpy().view(np.uint64), pa.compute.list_value_length(batch.column(2)).to_pylist()
            keys, owners, at = [], [], 0
            for own, n, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes):
                tokens = flat[at : at + size]
                at += size
                mixed = common.mix(tokens)
                for s in schemes.of(n):
                    for found in s.signatures(tokens, mixed, n):
                        keys.append(found)
                        owners.append(own)
            yield from _pieces(keys, owners)

    return run


def _emit_parities(batches):
    """class, n, alone and the parities of its shared elements' hash classes, from (class, n, tokens)."""
    for batch in batches:
        flat, sizes = batch.column(2).flatten().to_numpy().view(np.uint64), pa.compute.list_value_length(batch.column(2)).to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        bit = (common.mix(flat) & np.uint64(PARITY * 64 - 1)).astype(np.int64)
        odd = np.bincount(owner * PARITY * 64 + bit, minlength=batch.num_rows * PARITY * 64).astype(np.uint8) & 1
        words = np.packbits(odd.reshape(-1, 64), axis=1).view(np.int64).reshape(-1, PARITY)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(batch.column(1).to_numpy() - sizes), *[pa.array(words[:, i].copy()) for i in range(PARITY)]],
            names=["class", "n", "alone", *[f"p{i}" for i in range(PARITY)]],
        )


def _verifier(threshold: int):
    """Linked pairs, from (a, b, sizes of both, shared elements of both)."""

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            n, m = (batch.column(i).to_pylist() for i in (2, 3))
            x, y = batch.column(4), batch.column(5)
            xs, ys = x.flatten().to_numpy(), y.flatten().to_numpy()
            xo = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(x).to_numpy())])
            yo = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(y).to_numpy())])
            for i in range(batch.num_rows):
                both = np.concatenate([xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * shared >= threshold * (n[i] + m[i] - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], names=["a", "b", "good"])

    return run


def within(ids: DataFrame) -> DataFrame:
    """ids, broadcast if they are counted to be few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def classes(docs: DataFrame, n: int = N) -> DataFrame:
    """Per row: doc_id, n_shingles, class (of equal sets) and rep (the class's smallest doc_id; itself for empty sets)."""
    found = common.stored(docs.select("doc_id", "text").mapInArrow(common.frugal(_emit_sets(n)), "doc_id long, n_shingles long, class long"), "sets")
    reps = found.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))
    joined = found.join(reps, "class", "left")
    return common.stored(joined.select("doc_id", "n_shingles", "class", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "classes")


def representatives(docs: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, text): the rows that stand for a class, repeated ones once."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    held = of.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("rep")) & (F.col("n_shingles") > 0)).alias("stands"), F.count("*").alias("rows"))
    held = common.stored(held, "held")
    reps = texts.join(within(held.where("not stands").select("doc_id")), "doc_id", "left_anti")
    again = held.where("stands and rows > 1").select("doc_id")
    if again.isEmpty():
        return reps
    again = within(again)
    return reps.join(again, "doc_id", "left_anti").union(reps.join(again, "doc_id", "left_semi").distinct())


def candidates(reps: DataFrame, of: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """(class, n, tokens): the shared elements of the classes that may have a link."""
    signatures = reps.mapInArrow(common.frugal(_emit_signatures(n, threshold)), "key long, class long")
    # a key holds a class once, and a class spreads over as many keys as it may differ by: no key holds more than a small share of the rows
    shared = signatures.withColumn("classes", F.count("*").over(Window.partitionBy("key"))).where("classes > 1").select("class").distinct()
    shared = common.stored(shared, "sharing")
    ids = of.where("n_shingles > 0").join(within(shared), "class", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    ids = common.stored(ids, "sharing")
    elements = reps.join(within(ids), "doc_id", "left_semi").mapInArrow(common.frugal(_emit_elements(n)), "key long, class long")
    held = elements.withColumn("classes", F.count("*").over(Window.partitionBy("key"))).where("classes > 1").select("key", "class")
    tokens = held.groupBy("class").agg(F.collect_set("key").alias("tokens"))
    sizes = of.where("n_shingles > 0").groupBy("class").agg(F.min("n_shingles").alias("n"))
    return common.stored(tokens.join(sizes, "class").where(F.size("tokens") * 100 >= F.col("n") * threshold).select("class", "n", "tokens"), "tokens")


def _may_link(threshold: int) -> Column:
    """Whether sizes, shared elements and parities of two sets (columns ending in _a and _b) allow a link."""
    most = F.floor((F.col("n_a") + F.col("n_b")) * (100 - threshold) / (100 + threshold))
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITY)])
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold
    return near & (F.col("alone_a") + F.col("alone_b") + apart <= most)


def _sided(attrs: DataFrame, side: str) -> DataFrame:
    return attrs.select(*[F.col(c).alias(side if c == "class" else f"{c}_{side}") for c in attrs.columns])


def links(docs: DataFrame, of: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """(node, root) over the classes that have a link."""
    tokens = candidates(representatives(docs, of), of, n, threshold)
    parities = ", ".join(f"p{i} long" for i in range(PARITY))
    attrs = common.stored(tokens.mapInArrow(common.frugal(_emit_parities), f"class long, n long, alone long, {parities}"), "parities")
    found = common.stored(tokens.mapInArrow(common.frugal(_emit_graded(threshold)), "key long, class long"), "signatures")
    leaders = found.groupBy("key").agg(F.min("class").alias("b"), F.max("class").alias("high")).where("b <> high").select("key", "b")
    leaders = common.stored(leaders, "leaders")
    star = common.stored(found.join(leaders, "key").where("class <> b").groupBy(F.col("class").alias("a"), "b").agg(F.count("*").alias("votes")), "star")
    likely = common.stored(star.join(_sided(attrs, "a"), "a").join(_sided(attrs, "b"), "b").where(_may_link(threshold)).select("a", "b", "votes"), "likely")

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.select("a", "b").join(tokens.toDF("a", "n", "x"), "a").join(tokens.toDF("b", "m", "y"), "b")
        return common.stored(joined.select("a", "b", "n", "m", "x", "y").mapInArrow(common.frugal(_verifier(threshold)), "a long, b long, good boolean").where("good").select("a", "b"), "verified")

    def bridged(roots: DataFrame, more: DataFrame) -> DataFrame:
        placed = more
        for side in ("a", "b"):
            placed = placed.join(roots.toDF(side, f"root_{side}"), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
        joined = components(placed.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        old = roots.join(joined.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return common.stored(old.union(joined.join(roots.select("node"), "node", "left_anti")), "roots")

    first = common.stored(likely.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b")), "first")
    roots = common.stored(components(verified(first)), "roots")
    rest = likely.join(first, ["a", "b"], "left_anti").select("a", "b")
    for side in ("a", "b"):
        rest = rest.join(roots.toDF(side, f"root_{side}"), side, "left")
    rest = common.stored(rest.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"), "rest")
    more = verified(rest)
    if not more.isEmpty():
        roots = bridged(roots, more)
    placed = found.join(leaders.select("key"), "key", "left_semi").join(roots.toDF("class", "root"), "class", "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    placed = common.stored(placed, "placed")
    mixed = common.stored(placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"), "mixed")
    placed = common.stored(placed.join(mixed, "key", "left_semi").join(attrs, "class"), "placed")
    left, right = (_sided(placed.withColumnRenamed("key", "at"), side).withColumnRenamed(f"at_{side}", "key") for side in ("a", "b"))
    pairs = left.join(right, "key").where((F.col("root_a") < F.col("root_b")) & _may_link(threshold)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = common.stored(pairs.join(star.select("a", "b"), ["a", "b"], "left_anti"), "across")
    if pairs.isEmpty():
        return roots
    more = verified(pairs)
    return roots if more.isEmpty() else bridged(roots, more)


def groups(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    of = classes(docs, n)
    roots = links(docs, of, n, threshold)
    reps = of.where("n_shingles > 0").groupBy("class").agg(F.min("rep").alias("least"))
    placed = roots.toDF("class", "root").join(reps, "class")
    least = common.stored(placed.groupBy("root").agg(F.min("least").alias("component")), "components")
    linked = common.stored(placed.join(least, "root").select("class", "component"), "linked")
    joined = of.join(linked, "class", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.read(spark, sf_dir, "documents"))
