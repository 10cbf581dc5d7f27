"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and undoes digit and symbol substitutions, one character for one.
Lexicon entries are word beginnings learnt from labelled rows: an entry's weight is its smoothed log odds of the label,
and of entries that stand for the same rows only the longest common beginning stays. A match must start a word. Matches
within an exception phrase (given, or learnt as a two-word phrase that only clean rows hold) don't count. A text's
evidence is the sum of its matches' weights, also per word; a logistic fit on the labelled rows makes a score of both.

Defined results: null and empty texts have no evidence and get the score of such, below 0.5; without labelled rows of
both kinds the lexicon is empty and every score is the share of toxic rows (0 without any), still below 0.5; of several labels for a document the
larger counts; repeated rows score alike; other columns aren't read.
"""

from __future__ import annotations

import math
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: Labelled rows that a fit reads at most, picked by a hash of doc_id.
FIT_ROWS = 8_000
#: Entries of a lexicon at most, by weight times support.
ENTRIES = 2_000
PREFIXES = range(4, 13)
#: The highest score of a text without a match, however many labelled rows are toxic.
UNSEEN = 0.49
#: Toxic rows behind an entry, at least; more where chance alone would find that many for one of all entries.
SUPPORT = 3
WEIGHT = 2.5
#: Characters that stand for Latin letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "κ": "k", "υ": "u", "ı": "i", "ł": "l"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


class _Fold(dict):
    """The folding of single characters, filled as they are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        low = char.lower()
        out = SUBSTITUTES.get(low) or LOOKALIKES.get(low)
        if out is None:
            plain = unicodedata.normalize("NFKC", low)
            out = plain if len(plain) == 1 else low if len(low) == 1 else char
            out = LOOKALIKES.get(out, out)
        self[code] = out
        return out


_FOLD = _Fold()
_WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    """text folded; every character stays one character."""
    return text.translate(_FOLD)


def _starts(text: str, folded: str) -> list[tuple[int, str]]:
    """Word beginnings: runs of letters of the folded text, also where a run of symbols or digits that folding joined to it ends."""
    found = []
    for m in _WORD.finditer(folded):
        at, word = m.start(), m.group()
        found.append((at, word))
        k = 0
        while k < len(word) and not text[at + k].isalpha():
            k += 1
        if 0 < k < len(word):
            found.append((at + k, word[k:]))
    return found


class Lexicon:
    """Weighted word beginnings and exception phrases, as one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: set[tuple[str, str]], fit: tuple[float, ...]):
        self.weights, self.exceptions, self.fit = weights, exceptions, fit
        self.machine = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.machine.add_word(entry, (len(entry), weight))
        if weights:
            self.machine.make_automaton()

    def matches(self, text: str, folded: str) -> list[tuple[int, str, float]]:
        """(start, word, weight) of the matches that count, one for each word, the heaviest."""
        best: dict[int, float] = {}
        if self.weights:
            for last, (size, weight) in self.machine.iter(folded):
                at = last - size + 1
                if at and folded[at - 1].isalpha() and (text[at - 1].isalpha() or not text[at].isalpha()):
                    continue
                if weight > best.get(at, 0.0):
                    best[at] = weight
        out = []
        for at, weight in sorted(best.items()):
            word = _WORD.match(folded, at).group()
            if self.exceptions and any(p in self.exceptions for p in self.phrases(folded, at, word)):
                continue
            out.append((at, word, weight))
        return out

    @staticmethod
    def phrases(folded: str, at: int, word: str) -> list[tuple[str, str]]:
        """The two-word phrases that a match is part of."""
        before = re.search(r"(\w+)\W+$", folded[max(0, at - 60) : at])
        after = re.match(r"\W+(\w+)", folded[at + len(word) : at + len(word) + 60])
        return [*([(before[1], word)] if before else []), *([(word, after[1])] if after else [])]

    def evidence(self, text: str) -> tuple[float, float]:
        total = sum(w for _, _, w in self.matches(text, fold(text)))
        words = text.count(" ") + text.count("\n") + 1
        return total, 1000 * total / (words + 20)

    def score(self, text: str) -> float:
        a, b, c = self.fit
        x, y = self.evidence(text)
        p = 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * math.log1p(x) + c * math.log1p(y)))))
        return p if x else min(p, UNSEEN)


def _count_beginnings(batches):
    for rows, _, _ in common.steps(batches):
        counts: dict[str, list[int]] = {}
        for text, label in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
            words = {w for _, w in _starts(text or "", fold(text or ""))}
            for p in {w[:n] for w in words for n in PREFIXES if len(w) >= n}:
                counts.setdefault(p, [0, 0])[label > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["entry", "clean", "toxic"])


def _pick(rows: list, total: float, bad: float) -> dict[str, float]:
    """Weights of the entries that stay: per family of beginnings the longest that loses no rows."""
    weight = {r["entry"]: math.log((r["toxic"] + 0.5) / (bad + 1)) - math.log((r["clean"] + 0.5) / (total - bad + 1)) for r in rows}
    support = {r["entry"]: r["toxic"] for r in rows}
    longer_by_one: dict[str, list[str]] = {}
    for e in weight:
        longer_by_one.setdefault(e[:-1], []).append(e)
    kept: dict[str, float] = {}
    for entry in sorted(weight, key=lambda e: (len(e), e)):
        if any(entry[:n] in kept and kept[entry[:n]] >= weight[entry] - 1 for n in PREFIXES if n < len(entry)):
            continue
        last = entry
        while nexts := [e for e in longer_by_one.get(last, []) if support[e] >= 0.97 * support[entry]]:
            last = max(nexts, key=lambda e: (support[e], e))  # the only continuation that keeps the support
        kept[last] = weight[last]
    return kept


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions: set[tuple[str, str]] = frozenset()) -> Lexicon:
    """A lexicon from at most `rows` labelled documents (see common.train_rows)."""
    train = common.stored(common.train_rows(docs, labels, "toxic", rows), "toxic-fit")
    n, bad = train.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))).first()
    if not n or not bad or bad == n:
        share = bad / n if n else 0.0
        return Lexicon({}, set(exceptions), (math.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0))
    counted = train.select("doc_id", "text", "label").mapInArrow(common.frugal(_count_beginnings), "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = common.stored(counted, "entries")
    support = max(SUPPORT, math.ceil(math.log(max(counted.count(), 2)) / math.log(n / bad)))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (n - bad + 1))
    found = counted.where((F.col("toxic") >= support) & (odds >= WEIGHT)).orderBy((odds * F.sqrt("toxic")).desc(), "entry").limit(2 * ENTRIES).collect()
    kept = _pick(found, n, bad)
    bare = Lexicon(kept, set(exceptions), (0.0, 0.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast((kept, set(exceptions)))  # 2 x ENTRIES at most

    def phrases(batches):
        own = Lexicon(*shared.value, (0.0, 0.0, 0.0))
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                folded = fold(text or "")
                seen = {p for at, word, _ in own.matches(text or "", folded) for p in own.phrases(folded, at, word)}
                out += [(*p, int(label > 0)) for p in seen]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())], names=["a", "b", "toxic"])

    told = train.select("doc_id", "text", "label").mapInArrow(common.frugal(phrases), "a string, b string, toxic long").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    learnt = {(r["a"], r["b"]) for r in told.where("toxic = 0 and n >= 3").orderBy(F.col("n").desc(), "a", "b").limit(ENTRIES).collect()}
    bare.exceptions |= learnt
    shared_all = docs.sparkSession.sparkContext.broadcast((kept, bare.exceptions))

    def evidence(batches):
        own = Lexicon(*shared_all.value, (0.0, 0.0, 0.0))
        for batch in batches:
            found = [own.evidence(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column(2)], names=["x", "y", "label"])

    points = train.select("doc_id", "text", "label").mapInArrow(common.frugal(evidence), "x double, y double, label int").collect()  # FIT_ROWS at most
    x = np.array([[1.0, math.log1p(p["x"]), math.log1p(p["y"])] for p in points])
    return Lexicon(kept, bare.exceptions, _logistic(x, np.array([p["label"] > 0 for p in points], float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton steps for a ridge logistic fit."""
    w = np.zeros(x.shape[1])
    hold = np.eye(x.shape[1]) * ridge
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold + 1e-9 * np.eye(len(w)), x.T @ (p - y) + hold @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per document: doc_id, score, matches (array of word, start, weight)."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.fit))

    def run(batches):
        own = Lexicon(*shared.value)
        for rows, _, _ in common.steps(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([own.score(t or "") for t in rows.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(common.frugal(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """docs without those whose score reaches the threshold; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.fit))

    def run(batches):
        own = Lexicon(*shared.value)
        for rows, _, _ in common.steps(batches):
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            yield rows.filter(pa.array([own.score(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(common.frugal(run), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = scores(docs, learn(docs, common.read(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
