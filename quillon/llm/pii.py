"""Personal data by candidate generation and gradient boosting.

Base detectors (email, ip, card, phone) fix what is always found. High-recall generators propose further, overlapping
spans of the same kinds in looser forms: spelt-out or bracketed at and dot, addresses with a port or bracketed dots,
phone numbers without the plus sign, card numbers in other separators. A boosted-tree model per kind judges a candidate
by its format and context. It is trained here, on a bounded sample of documents: base spans and disguised copies of them,
put in their places, are personal data; candidates of the sample that aren't base spans, and copies made invalid (another
check digit, a part above 255, too few digits, plain words around "at"), are not. The threshold is calibrated on a third
of these that the fit doesn't see. Of overlapping spans base ones stay, then the surer, then the earlier.

Defined results: null and empty texts have no spans; repeated rows have equal spans; with too few weak labels of a kind
nothing is added for it; offsets are code points, ends exclusive; other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Documents whose candidates a fit reads at most (picked by a hash of doc_id), and candidates per kind.
FIT_DOCUMENTS = 4_000
FIT_CANDIDATES = 4_000
#: Share of accepted candidates of the sample that are base spans, at least; fewest positives for a model.
PRECISION = 0.99
POSITIVES = 20
ROUNDS, RATE, DEPTH = 40, 0.3, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_PROPOSE = {
    "email": re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._+-]{0,63}(?:@| ?[\[({]at[\])}] ?| at )[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({]dot[\])}] ?| dot )[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![\w]|\.[0-9])"),
    "card": re.compile(r"(?<![\w.+])[0-9]{4}(?:[\x20.\-/]?[0-9]{4}){2}[\x20.\-/]?[0-9]{1,7}(?!\w)"),
    "phone": re.compile(r"(?<![\w.])(?:\+|00)?[\x20]?(?:[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?(?:[\x20.\-/][0-9]{2,4}){1,4}(?!\w)"),
}
_HINT = {
    "email": re.compile(r"mail|contact|write|address|reply", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|port", re.I),
    "card": re.compile(r"card|visa|master|credit|pay", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|dial", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base(text: str) -> dict[str, list[tuple[int, int]]]:
    """The fixed detectors' spans, leftmost and without overlap per kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def propose(text: str) -> list[tuple[str, int, int]]:
    """Candidate spans of all kinds; they may overlap."""
    digits = _DIGIT.search(text) is not None
    out = []
    for kind, pattern in _PROPOSE.items():
        if digits if kind != "email" else "@" in text or " at " in text or "[at]" in text or "(at)" in text or "{at}" in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate; a leading plus or 00 isn't looked at."""
    body = text[start:end].lstrip("+")
    if kind == "phone" and body.startswith("00"):
        body = body[2:]
    groups = re.findall(r"[0-9]+", body)
    digits = "".join(groups)
    separators = re.sub(r"[0-9A-Za-z]+", "", body)
    before, after = text[max(0, start - 30) : start], text[end : end + 1]
    tail = [len(g) for g in groups[-3:]]
    return [
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        *[float(x) for x in [0] * (3 - len(tail)) + tail],
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0,
        float(max((int(g[:9]) for g in groups), default=0) <= 255),
        float(len(set(separators))),
        float("(" in separators),
        float(sum(c.isalpha() for c in body)),
        float(body.count(".")),
        float(len(re.findall(r"\bdot\b", body))),
        float("[" in separators or "{" in separators),
        float(len(re.split(r"\W+", body)[-1])),
        float(bool(_HINT[kind].search(before))),
        float(before[-1:].isalnum()),
        float(after.isalnum()),
        float(end - start),
    ]


class Boost:
    """Gradient-boosted regression trees for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH):
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.bias, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            score += self._apply(tree, x)

    def _grow(self, x, g, h, rows, depth, rate):
        leaf = rate * g[rows].sum() / (h[rows].sum() + 1.0)
        if depth == 0 or len(rows) < 8:
            return leaf
        best, parent = None, g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j])
            cuts = (values[1:] + values[:-1]) / 2
            if len(cuts) > 24:
                cuts = np.unique(np.quantile(cuts, np.linspace(0, 1, 24)))
            for c in cuts:
                left = x[rows, j] <= c
                a, b = rows[left], rows[~left]
                gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - parent
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, j, c, a, b)
        if best is None or best[0] <= 1e-9:
            return leaf
        return (best[1], float(best[2]), self._grow(x, g, h, best[3], depth - 1, rate), self._grow(x, g, h, best[4], depth - 1, rate))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        return np.where(left, self._apply(tree[2], x), self._apply(tree[3], x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for tree in self.trees:
            score += self._apply(tree, x)
        return 1 / (1 + np.exp(-score))


def disguised(kind: str, body: str) -> list[str]:
    """Other ways to write a base span, of which no base detector finds all."""
    if kind == "email":
        worded = body.translate(str.maketrans("0123456789", "abcdefghij"))
        return [x[: x.index("@")] + a + x[x.index("@") + 1 :].replace(".", d) for x in (body, worded) for a, d in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", "."))]
    if kind == "ip":
        return [body.replace(".", "[.]"), body + ":8080"]
    digits = re.sub(r"[^0-9]", "", body)
    if kind == "card":
        return [mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for mark in "./"]
    last = [digits[-10:-7], digits[-7:-4], digits[-4:]]
    front = [digits[:-10]] if len(digits) > 10 else []
    return [mark.join([*front, *last]) for mark in (" ", "-", ".")] + ["00" + " ".join([*front, *last]), "-".join(last), " ".join(last)]


def invalid(kind: str, body: str) -> list[str]:
    """What looks much like a base span, or like a disguised one, and isn't personal data."""
    if kind == "email":
        names = re.findall(r"[A-Za-z]+", body)
        if not names:  # 1@2.3 has no words to put around "at"
            return []
        return [f"{names[0]}{mark} at {names[-1]}{mark}.{name}" for name in (names[0], names[-1]) for mark in ("", "7")]
    if kind == "ip":
        parts = body.split(".")
        return [".".join([*parts[:3], "999"]), "[.]".join([*parts[:2], "512", parts[3]])]
    digits = re.sub(r"[^0-9]", "", body)
    if kind == "card":
        other = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [mark.join(other[i : i + 4] for i in range(0, len(other), 4)) for mark in ("", ".", "/")]
    a, b, c = digits[-2:], digits[-4:-2], digits[-8:-4]
    return [f"{c}-{b}-{a}", f"{a}.{b}.{c}", f"{a}/{b}/{c}", f"{a}.{b}.{c[:2]}", f"{digits[-3:]} {digits[-6:-3]}"]


def _is_base(found: dict[str, list[tuple[int, int]]], kind: str, start: int, end: int) -> bool:
    return any(a < end and start < b for a, b in found[kind])


def _examples(batches):
    for rows, _, _ in common.steps(batches):
        kinds, values, good = [], [], []

        def told(kind: str, text: str, start: int, end: int, label: int) -> None:
            kinds.append(kind)
            values.append(features(text, kind, start, end))
            good.append(label)

        for text in rows.column(0).to_pylist():
            text = text or ""
            found = base(text)
            for kind, a, b in propose(text):
                told(kind, text, a, b, int(_is_base(found, kind, a, b)))
            for kind, spans_ in found.items():
                for a, b in spans_:
                    before, after = text[max(0, a - 30) : a], text[b : b + 30]
                    for label, bodies in ((1, disguised(kind, text[a:b])), (0, invalid(kind, text[a:b]))):
                        for body in bodies:
                            near, low, high = before + body + after, len(before), len(before) + len(body)
                            for k, s, e in propose(near):
                                if k != kind and s < high and e > low:
                                    told(k, near, s, e, 0)
                                elif k == kind and min(e, high) - max(s, low) >= 0.8 * (max(e, high) - min(s, low)):
                                    told(kind, near, s, e, label)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.list_(pa.float64())), pa.array(good, pa.int32())], names=["kind", "x", "good"])


def learn(docs: DataFrame, documents: int = FIT_DOCUMENTS, candidates: int = FIT_CANDIDATES) -> dict[str, tuple[Boost, float]]:
    """Per kind a model and its threshold, from at most `documents` documents and `candidates` candidates of a kind, picked by hashes."""
    picked = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    sample = common.one_text(docs, picked).select("text").mapInArrow(_examples, "kind string, x array<double>, good int")
    sample = common.stored(sample.withColumn("order", F.xxhash64("x", "good")), "pii-fit")
    models: dict[str, tuple[Boost, float]] = {}
    rows: dict[str, list] = {k: sample.where(F.col("kind") == k).orderBy("order", "x").limit(candidates).collect() for k in KINDS}
    for kind, own in rows.items():
        x, y = np.array([r["x"] for r in own]), np.array([r["good"] for r in own], float)
        if y.sum() < POSITIVES:
            continue
        fit = np.arange(len(y)) % 3 > 0
        model = Boost(x[fit], y[fit])
        p, truth = model.probability(x[~fit]), y[~fit]
        order = np.argsort(-p, kind="stable")
        precision = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        if len(good):
            models[kind] = (model, max(0.9, float(p[order][good[-1]])))
    return models


def detect(text: str, models: dict[str, tuple[Boost, float]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start."""
    found = base(text)
    fixed = [(k, a, b) for k in KINDS for a, b in found[k]]
    taken = [(a, b) for _, a, b in fixed]
    more = [c for c in propose(text) if c[0] in models and not any(a < c[2] and c[1] < b for a, b in taken)]
    ranked = []
    for kind in {c[0] for c in more}:
        own = [c for c in more if c[0] == kind]
        model, least = models[kind]
        p = model.probability(np.array([features(text, *c) for c in own]))
        ranked += [(-q, c[1], KINDS.index(kind), c) for q, c in zip(p.tolist(), own) if q >= least]
    added = []
    for _, _, _, c in sorted(ranked):
        if not any(a < c[2] and c[1] < b for a, b in taken):
            taken.append(c[1:])
            added.append(c)
    return fixed, sorted(fixed + added, key=lambda c: (KINDS.index(c[0]), c[1]))


def spans(docs: DataFrame, models: dict[str, tuple[Boost, float]]) -> DataFrame:
    """Per document: doc_id, base and found (arrays of kind, start, end as text)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # ROUNDS trees of 2 ^ DEPTH leaves for each kind

    def run(batches):
        for rows, _, _ in common.steps(batches):
            both = [detect(t or "", shared.value) for t in rows.column(1).to_pylist()]
            texts = [[[f"{k}:{a}:{b}" for k, a, b in side] for side in pair] for pair in both]
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([t[0] for t in texts], lists), pa.array([t[1] for t in texts], lists)], names=["doc_id", "base", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, base array<string>, found array<string>")


def _count(kind: str) -> Column:
    """How many base spans are of a kind; a lambda's second parameter, even with a default, would be the span's index."""
    return F.size(F.filter("base", lambda span: span.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    table = spans(docs, learn(docs))
    return table.select("doc_id", *[_count(k) for k in KINDS], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("found", ",").alias("spans"))
