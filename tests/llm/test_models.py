"""Learnt operators: held-out accuracy, exact base detectors, folding."""

import hashlib
import re

from pyspark.sql import functions as F

from quillon.llm import common, pii, quality, toxicity


def test_toxicity_held_out(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    joined = toxicity.scores(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    bad = [r for r in joined if r["toxic"] == 1]
    clean = [r for r in joined if r["toxic"] == 0]
    assert sum(r["score"] >= 0.5 for r in bad) >= 0.9 * len(bad) and sum(r["score"] >= 0.5 for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in joined)


def test_quality_held_out(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    joined = quality.scores(docs, quality.learn(docs, labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in joined) >= 0.97 * len(joined)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "bad": 1.0}, {("idiot", "proof")}, (-3.0, 1.0, 1.0))
    words = lambda t: [w for _, w, _ in lexicon.matches(t, toxicity.fold(t))]
    assert words("You 1d10t!") and words("іdіоt") and words("IDIOTS") == ["idiots"] and words("ｉｄｉｏｔ")
    assert words("an idiot-proof lid") == [] and words("reidiot") == [] and words("x$$$ idiot$$$") != []
    assert lexicon.score("an idiot") > lexicon.score("an " + "fine " * 2000 + "idiot") > lexicon.score("fine") > 0
    assert all(len(toxicity.fold(c)) == 1 for c in "aÄßİﬃ①㎏Я")


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_base_detectors_are_the_patterns(rng):
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m)),
        "phone": lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15,
    }
    pieces = ["a@b.c", "@", ".", "-", " ", "1", "25", "300", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (319) 555-5132", "+", "x", "1.2.3.4", "0255", "(", ")", "a.b+c@d-e.f.g", "٣", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        want = {k: [m.span() for m in re.finditer(p, text) if good[k](m.group())] for k, p in PATTERNS.items()}
        assert pii.base(text) == want, text


def test_pii_query_counts_the_patterns(spark, odd, rng, tmp_path):
    """All exact columns of the query, on odd rows and on texts with no, one and many spans of a kind."""
    good = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m)), "phone": lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15}
    pieces = ["a@b.cc", "é.x@d-e.f.g", "1.2.3.4", "1.2.3.256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (319) 555-5132", "+12", "x", "\U0001f389", "email:1"]
    texts = pieces + [" / ".join(rng.choice(pieces) for _ in range(n)) for n in range(2, 40)]
    made = [(i // 2, t) for i, t in enumerate([*texts, None, ""])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in docs.collect():
        found = {k: [m.span() for m in re.finditer(p, r["text"] or "") if good[k](m.group())] for k, p in PATTERNS.items()}
        spans = ",".join(f"{k}:{a}:{b}" for k in found for a, b in found[k])
        want.append((r["doc_id"], *map(len, found.values()), hashlib.sha256(spans.encode()).hexdigest()))
    got = pii.op9_pii(spark, str(tmp_path)).select("doc_id", *[f"n_{k}" for k in PATTERNS], "base_sha256")
    assert [t for _, t in got.dtypes] == ["bigint"] * 5 + ["string"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert all(max(w[i] for w in want) > 1 for i in range(1, 5))


def test_pii_of_addresses_without_letters(spark):
    """An address of digits and signs has no lookalike in words; fits read it all the same."""
    assert pii.invalid("email", "1@2.3") == []
    docs = spark.createDataFrame([(i, f"{i}@2.3 or %@--.-, 00.0.0.255 or +1((((((((((23456789") for i in range(30)], "doc_id long, text string")
    rows = {r["doc_id"]: r["base"] for r in pii.spans(docs, pii.learn(docs)).collect()}
    assert rows[7] == ["email:0:5", "email:9:15", "ip:17:27", "phone:31:51"]


def test_boosted_trees_learn_and_add(spark):
    rows = [f"we met. call +1 ({300 + i % 600}) 555-{1000 + i % 9000} or see rows {i}-{i + 1} of 12 34 and {i % 28 + 1}.{i % 12 + 1} too" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    models = pii.learn(docs)
    base, found = pii.detect("now dial (319) 555-5132 please, in 2020-01-02", models)
    assert base == [] and [c[0] for c in found] == ["phone"]
    assert pii.detect("sections 3-4 and 12.5 of 1999", models)[1] == []
    text = "write to a@b.cc or +1 (319) 555-5132"
    base, found = pii.detect(text, models)
    assert set(base) <= set(found) and [k for k, _, _ in base] == ["email", "phone"]


def test_disguised_data_is_found_and_lookalikes_are_left(spark):
    """On documents that the fit hasn't read: most disguised spans are added, hardly any invalid ones, none in untouched texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    models = pii.learn(docs)
    assert set(models) == set(pii.KINDS)
    read = {r[0] for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(pii.FIT_DOCUMENTS).collect()}
    told = {1: [0, 0], 0: [0, 0]}
    for r in docs.where("text is not null").select("doc_id", "text").collect():
        if r["doc_id"] in read:
            continue
        found = pii.base(r["text"])
        base, all_ = pii.detect(r["text"], models)
        assert base == all_
        for kind, spans in found.items():
            for a, b in spans:
                for label, bodies in ((1, pii.disguised(kind, r["text"][a:b])), (0, pii.invalid(kind, r["text"][a:b]))):
                    for body in bodies:
                        near = r["text"][max(0, a - 40) : a] + body + r["text"][b : b + 40]
                        base, all_ = pii.detect(near, models)
                        added = [c for c in all_ if c not in base and c[1] < a - max(0, a - 40) + len(body) and c[2] > a - max(0, a - 40)]
                        told[label][0] += 1
                        told[label][1] += bool(added) if label == 0 else bool(added) or bool(base)
    assert told[1][1] >= 0.9 * told[1][0] and told[0][1] <= 0.02 * told[0][0], told


def test_fit_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 7 + 1, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] * 3, "doc_id long, toxic int")
    for bound in (2, 10):
        rows = common.train_rows(docs, labels, "toxic", bound).collect()
        assert 0 < len(rows) <= bound and len({r["doc_id"] for r in rows}) == len(rows)
