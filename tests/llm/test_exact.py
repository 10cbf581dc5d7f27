"""Exact operators against brute force on small corpora."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillon.llm import bpe, common, components, decontaminate, jaccard_join, line_dedup, qalsh, sharding, substring_dedup
from tests.llm.conftest import frame, prose


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_word_hashes_follow_words(rng):
    texts = ["", "a", " b  c\n", "é x\x0by", "a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    h, first = common.words(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]), "space", False)
    split = [re.findall("[^\x20\x09-\x0d]+", t) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in split]
    seen = {}
    for w, x in zip((w for s in split for w in s), h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- near duplicates


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(docs):
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(rng):
    """Groups of near copies whose members needn't be near each other, a passage that many share, small sets, copies."""
    texts = []
    for size in (6, 9, 14, 25, 60, 150):
        base = prose(rng, size)
        for _ in range(18):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 60 + 1))):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice(([], [rng.choice("xyzuv") * 3], [own[k], "more"]))
            texts.append(" ".join(own))
    passage = prose(rng, 40)
    for _ in range(60):
        own = prose(rng, 70)
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += ["one two", "One  TWO", "one two three", "", " "] + [texts[3]] * 5
    rng.shuffle(texts)
    return texts


def test_jaccard_groups(spark, rng):
    docs = frame(spark, corpus(rng))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(docs).collect()}
    assert got == brute_groups(texts_of(docs))
    assert len({c for _, c in got.values()}) < len(got) - 60


def test_jaccard_shuffled_join_path(spark, rng, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", -1)
    docs = frame(spark, corpus(rng)[:70])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(docs).collect()}
    assert got == brute_groups(texts_of(docs))


def test_layouts_leave_no_pair_out():
    """Every pair of sets at the threshold shares a signature in both layouts, for all sizes up to 120."""
    schemes = jaccard_join.Schemes(80)
    r = np.random.default_rng(3)

    def keys(t, shared=None):
        if shared is None:
            return {k for s in schemes.of(len(t)) for k in s.all.signatures(t, common.mix(t), s.own(len(t))).tolist()}
        return {k for s in schemes.of(len(t)) for part in s.signatures(shared, common.mix(shared), len(t)) for k in part.tolist()}

    for size in range(1, 120):
        for _ in range(6):
            base = r.integers(0, 1 << 63, size * 2, dtype=np.uint64)
            x = base[:size]
            gone = int(r.integers(0, size // 5 + 1))
            most = next(k for k in range(size, -1, -1) if 100 * (size - gone) >= 80 * (size + k))
            y = np.concatenate([x[gone:], base[size : size + int(r.integers(0, most + 1))]])
            if not len(y):
                continue
            x, y = np.unique(x), np.unique(y)
            assert keys(x) & keys(y), (size, gone, len(y))
            alone = [np.setdiff1d(t, o)[: int(r.integers(0, size + 1))] for t, o in ((x, y), (y, x))]  # elements that no other set holds
            assert keys(x, np.setdiff1d(x, alone[0])) & keys(y, np.setdiff1d(y, alone[1])), (size, gone, len(y))


def test_jaccard_rows_of_one_id(spark):
    """Rows of one doc_id are judged by their own texts; repeated rows are one class."""
    a, b = "one two three four five six seven", "quite other words than those of the first"
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (3, b), (None, a)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(docs).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 4, 1), (1, 4, 1), (2, 3, 1), (3, 4, 1), (None, 3, None)], key=str)


def test_components(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (7, None)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: root(x) for x in up}


# --- lines


def test_edit_distance(rng):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, e in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    for _ in range(800):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert line_dedup.distance(a, b) == plain(a, b)
        c, d = (" ".join(x) for x in (a, b))
        assert line_dedup.aligned(c, d) >= plain(c, d)


def line_places(docs):
    """The places of each normalised line, and its SimHash and blocks."""
    occurrences = defaultdict(list)
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            body = line_dedup.normalise(line)
            if len(body.split(" ")) >= line_dedup.MIN_WORDS:
                occurrences[body].append((d, i))
    marks = {}
    for b in occurrences:
        data = np.frombuffer(b.encode(), np.uint8)
        h, first = common.words(data, np.array([0, len(data)]), "space", False)
        whole = line_dedup.simhash(h, first)
        marks[b] = int(whole[0]), set(line_dedup.line_blocks(h, first, whole)[1].tolist()), len(b), [int(x[0]) for x in line_dedup.parities(h, first)], len(h)
    return occurrences, marks


def meets(x, y):
    most = line_dedup.BRIEF_DISTANCE if min(x[2], y[2]) < line_dedup.BRIEF else line_dedup.DISTANCE
    changed = sum((a ^ b).bit_count() for a, b in zip(x[3], y[3]))
    return (x[0] ^ y[0]).bit_count() <= most and 100 * (changed - line_dedup.SPARE) <= line_dedup.CHANGED * min(x[4], y[4]) and bool(x[1] & y[1])


def brute_lines(docs, candidate=meets):
    """Each place of a line, and the first place of its group by all links among candidates."""
    occurrences, marks = line_places(docs)
    bodies = sorted(occurrences)
    up = list(range(len(bodies)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(bodies):
        for j, b in enumerate(bodies[:i]):
            if candidate(marks[a], marks[b]) and line_dedup.similar(a, b):
                up[root(i)] = root(j)
    group = defaultdict(list)
    for i, b in enumerate(bodies):
        group[root(i)] += occurrences[b]
    return {p: min(places) for places in group.values() for p in places}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice(([], [rng.choice("xyzuv") * 3], [words[k], "more"]))
    return " ".join(words)


@pytest.mark.parametrize("entries", [2_000_000, -1])
def test_line_dedup(spark, rng, monkeypatch, entries):
    """Exactly the links among lines that share a block; nearly all links there are."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ENTRIES", entries)
    base = [prose(rng, n) for n in (5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 60, 90) for _ in range(4)]
    lines = [" ".join(w) for w in base] + [edited(rng, w, rng.randint(1, max(1, len(w) // 12))) for w in base for _ in range(2)]
    lines += [x.replace("the", "The,") for x in lines[:10]] + [x + "!" for x in lines[10:20]] + [x + " 7" for x in lines[:6]] + [x + " 8" for x in lines[:6]]
    short = ["ok", "a b c d", ""]
    texts = ["\n".join(rng.choice(lines + short) for _ in range(rng.randint(1, 6))) for _ in range(70)]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    keep = brute_lines(texts_of(docs))
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if keep.get((d, i), (d, i)) == (d, i)) for d, t in texts_of(docs)}
    assert got == want
    complete = brute_lines(texts_of(docs), lambda x, y: True)
    gone = {p for p, first in complete.items() if p != first}
    assert len(gone) > 60 and len([p for p in gone if keep[p] != p]) >= 0.92 * len(gone)


def test_line_recall(spark, data):
    """Of the similar lines that share three words in a row, on the driver's documents, at least 92 % share a block and have near SimHashes."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    _, marks = line_places(docs)
    held = defaultdict(set)
    for b in marks:
        w = b.split(" ")
        for k in range(len(w) - 2):
            held[tuple(w[k : k + 3])].add(b)
    pairs = {(x, y) for group in held.values() if len(group) < 40 for x in group for y in group if x < y}
    links = [(x, y) for x, y in pairs if line_dedup.similar(x, y)]
    assert links and sum(meets(marks[x], marks[y]) for x, y in links) >= 0.92 * len(links)


def test_lines_that_fail_against_the_first_of_their_simhash(spark, rng):
    texts = [" ".join(["ha"] * n) for n in (5, 6, 9, 10, 14, 22, 23, 40, 41, 70, 71, 72, 110)]
    tails = [prose(rng, 2) for _ in range(12)]
    texts += [" ".join(["ho"] * n + tail) for n in (8, 13, 30, 31) for tail in tails]
    texts += [" ".join(["ho"] * 30 + tail + prose(rng, 12)) for tail in tails]
    docs = frame(spark, texts)
    want = brute_lines(texts_of(docs))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == {d: t if want[d, 0] == (d, 0) else "" for d, t in texts_of(docs)}
    assert not got[8] and not got[6] and not got[10] and len(set(want.values())) > 6  # 40 and 41 repeats are one line, 22 and 23, 70 and 71


# --- benchmark items


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = alnum(t), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_decontamination(spark, rng, block):
    items = [(i, " ".join(prose(rng, rng.choice((3, 9, 10, 11, 25))))) for i in range(14)] + [(14, "Re-state, the THING"), (15, "re state the thing"), (16, ""), (17, None), (None, "lost words here")]
    texts = []
    for k in range(50):
        own = prose(rng, rng.randint(0, 60))
        if k % 2:
            w = items[k % 16][1].split()
            at = rng.randrange(len(own) + 1)
            own[at:at] = w[: rng.choice((len(w), len(w) - 1, 12))]
        texts.append(" ".join(own).title() if k % 3 else "; ".join(own))
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.digest(decontaminate.hits(docs, bench, block_bytes=block))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()}
    want = brute_hits(texts_of(docs), [x for x in items if x[0] is not None])
    assert got == want and sum(v[4] for v in want.values()) > 15
    if block > 200:
        cleaned = dict(map(tuple, decontaminate.clean(docs, bench, coverage=1.0).collect()))
        for d, t in texts_of(docs):
            assert len(alnum(cleaned[d])) == want[d][0] - want[d][1] and (want[d][4] or cleaned[d] == t)


def test_cleaning_does_not_depend_on_blocks(spark, rng):
    words = [f"{a}{i}" for a in "abc" for i in range(40)]
    one, two = words[:25], words[20:45]  # the end of one is the beginning of two
    items = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(words[60:72]))], "item_id long, text string")
    own = prose(rng, 5)
    texts = {
        "half each": " ".join(one[:12] + own + two[10:22]),  # more than 0.8 with both blocks, less with each
        "overlap": " ".join(own * 6 + words[10:40] + own * 6),
        "joined": " ".join(own * 6 + words[60:66] + one[:12] + words[66:72] + own * 6),  # a window of 3 only once 1 is cut
        "clean": " ".join(own * 3),
    }
    docs = spark.createDataFrame([(t, k, i) for i, (k, t) in enumerate(texts.items())] + [(None, "null", 9), ("", "empty", None)], "text string, rest string, starts int")
    want = {"overlap": " ".join(own * 6 + own * 6), "joined": " ".join(own * 6 + words[60:66] + words[66:72] + own * 6), "clean": texts["clean"], "null": None, "empty": ""}
    for block in (decontaminate.BLOCK_BYTES, 10):
        out = decontaminate.clean(docs, items, block_bytes=block)
        assert out.schema == docs.schema
        assert {r["rest"]: r["text"] and " ".join(r["text"].split()) for r in out.collect()} == want


def test_rows_stay_apart_whatever_the_blocks(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, "five six seven eight")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "one two three four x y"), (None, "a b five six seven eight"), (7, "one two three four"), (7, "one two three four")], "doc_id long, text string")
    want = [(7, 4, 4, 1), (7, 4, 4, 1), (None, 6, 4, 1), (None, 6, 4, 1)]
    for block in (decontaminate.BLOCK_BYTES, 10):
        rows = decontaminate.digest(decontaminate.hits(docs, items, block_bytes=block)).select("doc_id", "n_words", "n_hit", "n_items").collect()
        assert sorted(map(tuple, rows), key=str) == want


# --- repeated passages


def brute_kept(docs, n):
    words = {d: (t or "").encode().split() for d, t in docs}
    count = Counter(tuple(w[k : k + n]) for w in words.values() for k in range(len(w) - n + 1))
    out = {}
    for d, w in words.items():
        gone = {i for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for i in range(k, k + n)}
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


@pytest.mark.parametrize("broadcast", [2_000_000, -1])
def test_substring_dedup(spark, rng, monkeypatch, broadcast):
    monkeypatch.setattr(substring_dedup, "BROADCAST_ENTRIES", broadcast)
    passages = [prose(rng, n) for n in (34, 35, 36, 50, 90)]
    texts = []
    for k in range(60):
        own = prose(rng, rng.randint(0, 120))
        for _ in range(k % 3):
            p, at = rng.choice(passages), rng.randrange(len(own) + 1)
            cut = rng.randrange(len(p))
            own[at:at] = p if rng.random() < 0.5 else p[cut:] + p[:cut]
        texts.append(" ".join(own))
    texts += [" ".join(["x"] * 35), " ".join(["x"] * 36), " ".join(["y"] * 200), texts[5], texts[5]]
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.cut(docs).collect()}
    assert got == brute_kept(texts_of(docs), 35)
    for r in substring_dedup.spans(docs).collect():
        assert all(e - s >= 35 for s, e in zip(r["starts"], r["ends"]))


# --- tokens


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact(spark, reference, rng):
    alphabet = "ab cdeéßñ的テ🎉0123'!\n\t<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 3000, "<|endoftext|>", "don't  they're\n\n"]
    docs = frame(spark, texts)
    want = {d: reference.encode_ordinary(t) for d, t in texts_of(docs)}
    for r in bpe.encode(docs).collect():
        assert r["ids"] == want[r["doc_id"]] and bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    for r in bpe.digests(docs).collect():
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want[r["doc_id"]]), hashlib.sha256(",".join(map(str, want[r["doc_id"]])).encode()).hexdigest())


def test_bpe_forgetting_changes_nothing(reference, monkeypatch, data, spark):
    monkeypatch.setattr(bpe, "SHORT", 6)
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    own = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, remembered=50)
    for t in texts:
        assert [int(i) for p in own.encode([t])[0] for i in p[1].split(b",")] == reference.encode_ordinary(t)


def test_bpe_remembers_pieces_that_come_again():
    own = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    learnt, plain = [], own.learn
    own.learn = lambda pieces: learnt.append(len(pieces)) or plain(pieces)
    steps = [" ".join(f"x{chr(97 + k)}{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(6_000)) for k in range(20)]
    first = [own.encode([t]) for t in steps]
    assert sum(learnt) == 120_000
    assert [own.encode([t]) for t in steps] == first and sum(learnt) == 120_000


def test_workers_give_memory_back():
    rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    pinned = []

    def hungry(batches):
        held = [bytes(2_000) for _ in range(60_000)]
        pinned.append(bytearray(2_000))  # above all the others in the heap
        yield from batches
        assert rss() > before + 80_000_000 and held

    before = rss()
    assert list(common.frugal(hungry)(iter([1, 2]))) == [1, 2]
    assert rss() < before + 40_000_000


def test_bpe_white_space(reference):
    own = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    for t in ("", " ", "  a", "a  b", "a \n b\n", "\n", "x\t y ", "'s 't it's I'll  ", "a b c\x1c d", "1 2  3", "　 x", "\u00a0 y", "tab\there  and \r\n there "):
        assert [int(i) for p in own.encode([t])[0] for i in p[1].split(b",")] == reference.encode_ordinary(t), t


# --- shards


def test_sharding_law(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sharding.assign(docs, sharding.tree(24), sharding.tree(25)).collect()
    text = dict(texts_of(docs))
    assert all(r["size"] == 8 + len(text[r["doc_id"]].encode()) and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_sharding_is_balanced_and_confined(spark):
    keys = spark.range(30_000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.tree(24)
    heavier = sharding.Node("root", (tree.children[0], tree.children[1], sharding.Node("region2", (tree.children[2].children[0], sharding.Node("rack1", (*tree.children[2].children[1].children[:3], sharding.Node("shard23", weight=3.0, shard=23)))))))
    rows = keys.select(sharding.place(F.col("k"), tree).alias("a"), sharding.place(F.col("k"), heavier).alias("b")).collect()
    counts = Counter(r["a"] for r in rows)
    assert len(counts) == 24 and max(counts.values()) < 1.25 * min(counts.values())
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(b >= 16 for _, b in moved)  # only into the region whose weight grew
    assert sum(r["b"] == 23 for r in rows) > 2 * counts[23]


# --- neighbours


def test_nearest_recall_and_ties(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = r.standard_normal((3000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:160] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [0.1] * 23), (5003, [None] + [0.1] * 23), (None, [0.1] * 24), (5020, [0.1] * 3)]
    monkeypatch.setattr(qalsh, "BLOCK_ROWS", 1500)
    monkeypatch.setattr(qalsh, "LEAST", 4)
    got = defaultdict(list)
    for x in sorted(qalsh.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda x: x["rank"]):
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    hit = 0
    for q in range(0, 3000, 20):
        s = v @ v[q]
        s[q] = -9
        want = np.lexsort((np.arange(3000), -np.round(s, 12)))[:20]
        hit += len({i for i, _ in got[q]} & set(want.tolist()))
        assert len(got[q]) == 20 and all(abs(x - s[i]) < 1e-9 for i, x in got[q])
    assert set(got) == set(range(0, 3000, 20)) and hit >= 0.9 * 150 * 20
    assert [i for i, _ in got[100]] == [7, *range(101, 120)]  # copies tie, the smallest ids win


def test_small_sets_are_searched_whole(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0])]
    got = [tuple(x) for x in qalsh.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]
