"""Byte-level BPE by backtracking over longest matches, exact to the merge order, in linear time.

Bytes are mapped to Latin-1 so that pyahocorasick can hold every token. A piece (one match of the pattern) is first cut
by the automaton's longest matches; if all adjacent pairs are compatible (the merges of the pair's bytes keep that
border) this is the answer. Otherwise the encoder backtracks: the last token gives way to its next shorter prefix token,
or goes, and an end that failed is never tried again. The idea of backtracking over compatible pairs is that of the `bpe`
crate of GitHub's rust-gems (MIT licence); tables, the test of a border and the memory are this module's own.

Whether a border holds is read off two time lines. Merges go by rank, so while a token is built its right edge is one
symbol after another, each from its own rank to the next one's, and likewise the left edge. The border falls if at some
time the two symbols that meet there merge, before either side's next merge (of equal ranks the left one goes first).

What a piece encodes to is remembered, and whether a pair of tokens is compatible: in two generations, of which the older
goes when the younger is full. Results don't depend on what is remembered.

Defined results: null and empty texts have no tokens; decoding gives the bytes back; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces, and as many pairs, after which a generation of the memory ends; a task's end clears it.
REMEMBERED = 150_000
#: Characters of the longest piece that is remembered.
SHORT = 64
#: Bytes of text that are encoded together.
STEP = 1 << 19
_NEVER = 1 << 60


class Memory:
    """A map of two generations: what was asked for since the last turn, and what before."""

    def __init__(self, bound: int):
        self.bound, self.young, self.old = bound, {}, {}

    def turn(self) -> None:
        """Forget the older generation if the younger has grown to its bound."""
        if len(self.young) >= self.bound:
            self.young, self.old = {}, self.young

    def missing(self, keys: set) -> list:
        """The keys that aren't known; all others are young from now on."""
        young, old, out = self.young, self.old, []
        for key in keys.difference(young):
            found = old.get(key)
            if found is None:
                out.append(key)
            else:
                young[key] = found
        return out


class Encoder:
    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.bytes = [b""] * size
        for body, rank in self.ranks.items():
            self.bytes[rank] = body
        self.names = [b"%d" % i for i in range(size)]
        self.split = regex.compile(pattern).findall
        self.machine = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.machine.add_word(token.decode("latin-1"), rank)
        self.machine.make_automaton()
        self.longest = max(map(len, self.ranks))
        self.sizes = [len(b) for b in self.bytes]
        #: Of each token the longest that is a proper prefix of it; -1 if there is none.
        self.shorter = [next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1) for b in self.bytes]
        self.first: dict[str, int] = {}
        self.merges: dict[int, int] = {}  # left << 32 | right of all two tokens that are one: its rank
        for body, rank in self.ranks.items():
            for n in range(1, len(body)):
                left, right = self.ranks.get(body[:n]), self.ranks.get(body[n:])
                if left is not None and right is not None:
                    self.merges[left << 32 | right] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.fits, self.pieces = Memory(self.remembered), Memory(self.remembered)

    def halves_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, and for a token that no merges make."""
        if token not in self.halves:
            body, found = self.bytes[token], None
            parts = [self.ranks[body[i : i + 1]] for i in range(len(body))]
            while len(parts) > 1:
                ranked = [self.merges.get(a << 32 | b, _NEVER) for a, b in zip(parts, parts[1:])]
                least = min(ranked)
                if least == _NEVER:
                    break
                at = ranked.index(least)
                if len(parts) == 2:
                    found = (parts[0], parts[1])
                parts[at : at + 2] = [least]
            self.halves[token] = found
        return self.halves[token]

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """What stands at one edge of a token while it is built: (symbol, rank of the merge that ends its time), in order."""
        known = self.edges[right]
        found = known.get(token)
        if found is None:
            halves = self.halves_of(token)
            if halves is None:
                found = [(token, _NEVER)]
            else:
                inner = self.edge(halves[right], right)
                found = [*inner[:-1], (inner[-1][0], token), (token, _NEVER)]
            known[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether left, right is what the merges make of both tokens' bytes together."""
        ours, theirs, merges = self.edge(left, True), self.edge(right, False), self.merges
        i = j = 0
        while True:
            (x, until), (y, end) = ours[i], theirs[j]
            rank = merges.get(x << 32 | y)
            if rank is not None and rank < until and rank <= end:
                return False
            if until <= end:
                if until == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def holds(self, key: int) -> bool:
        """compatible, of left << 32 | right, remembered."""
        found = self.fits.old.get(key)
        if found is None:
            found = self.compatible(key >> 32, key & 0xFFFFFFFF)
        self.fits.young[key] = found
        return found

    def first_of(self, prefix: str) -> int:
        """The longest token that prefix starts with."""
        body = prefix.encode("latin-1")
        for n in range(len(body), 0, -1):
            if body[:n] in self.ranks:
                self.first[prefix] = self.ranks[body[:n]]
                return self.first[prefix]
        raise ValueError(f"no token for {body!r}")

    def backtrack(self, latin: str, out: list[int], token: int = -1) -> list[int]:
        """Tokens whose neighbours are all compatible, longest first; failed: ends that didn't lead on.

        out: longest matches at the start that are compatible, changed here; token: the longest match that follows."""
        sizes, shorter, fits, first, prefix, longest = self.sizes, self.shorter, self.fits.young, self.first, self.machine.longest_prefix, self.longest
        size, failed, at = len(latin), set(), sum([sizes[t] for t in out])
        while at < size:
            if token < 0:
                ahead = latin[at : at + longest]
                ahead = ahead[: prefix(ahead)]
                token = first.get(ahead)
                if token is None:
                    token = self.first_of(ahead)
            while True:
                end = at + sizes[token]
                if end not in failed:
                    if not out:
                        break
                    key = out[-1] << 32 | token
                    good = fits.get(key)
                    if good is None:
                        good = self.holds(key)
                    if good:
                        break
                token = shorter[token]
                while token < 0:
                    failed.add(at)
                    token = out.pop()
                    at -= sizes[token]
                    token = shorter[token]
            out.append(token)
            at, token = end, -1
        return out

    def learn(self, pieces: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Number of tokens, ids as text and bytes of each piece; all longest matches in one run of the automaton."""
        latins = [p.encode().decode("latin-1") for p in pieces]
        last, tokens = np.array(list(self.machine.iter_long("Ā".join(latins))), np.int64).T
        ends = np.cumsum(np.array([len(b) + 1 for b in latins], np.int64)) - 1
        owner = np.searchsorted(ends, last, "right")
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tokens[inside] << 32 | tokens[inside + 1], return_inverse=True)
        fits, holds = self.fits.young, self.holds
        good = np.array([fits[p] if p in fits else holds(p) for p in pairs.tolist()], bool)
        wrong = inside[~good[which]]
        bad, at = np.unique(owner[wrong], return_index=True)
        cuts = np.searchsorted(owner, np.arange(len(pieces) + 1)).tolist()
        ids, names, body = tokens.tolist(), self.names, self.bytes
        found = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for k, left in zip(bad.tolist(), wrong[at].tolist()):
            found[k] = self.backtrack(latins[k], ids[cuts[k] : left + 1], ids[left + 1])
        return [(len(f), b",".join([names[i] for i in f]), b"".join([body[i] for i in f])) for f in found]

    def encode(self, texts: list[str]) -> list[list[tuple[int, bytes, bytes]]]:
        """Per text, per piece: number of tokens, their ids as text, their bytes."""
        self.fits.turn()
        self.pieces.turn()
        cut = list(map(self.split, texts))
        fresh = self.pieces.missing(set(chain.from_iterable(cut)))
        known = self.pieces.young
        if fresh:
            known.update(zip(fresh, self.learn(fresh)))
        out = [list(map(known.__getitem__, pieces)) for pieces in cut]
        for p in fresh:
            if len(p) > SHORT:
                del known[p]
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _chunks(texts: pa.Array):
    """Texts of about STEP bytes at a time, as strings; nulls as empty ones."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP, "right")))
        yield [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per document: doc_id, ids (token ids) and decoded (the bytes they stand for).

    path: the rank file; by default the public multi-language one, looked up on each machine. No match of the pattern
    may run from a visible character into white space."""

    def run(batches):
        own = encoder(path or public_tokenizers.path(VOCABULARY), pattern)
        for batch in batches:
            ids, decoded = [], []
            for texts in _chunks(batch.column(1)):
                for found in own.encode(texts):
                    ids.append([int(i) for f in found for i in f[1].split(b",")])
                    decoded.append(b"".join([f[2] for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])
        own.forget()

    return docs.select("doc_id", "text").mapInArrow(common.frugal(run), "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, taken where the ids are made."""

    def run(batches):
        own = encoder(path or public_tokenizers.path(VOCABULARY), pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for texts in _chunks(batch.column(1)):
                for found in own.encode(texts):
                    counts.append(sum([f[0] for f in found]))
                    ids.append(hashlib.sha256(b",".join([f[1] for f in found])).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return docs.select("doc_id", "text").mapInArrow(common.frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))
