"""Quality classifier: perplexity under an interpolated modified Kneser-Ney
trigram model of trusted text.

Trusted text is all documents labelled good, from four folds of five (by a hash of
the id; the fifth gives the thresholds). Trigrams are counted
and joined with their context counts and lower orders as DataFrames, giving a
probability for each seen trigram and bigram and a back-off weight for each
context. Words seen once stand for unknown words (with those beyond the
``VOCABULARY`` commonest, and very long ones); an unknown word costs its share
among them, so text of odd strings is unlikely text.

Every document is turned into word ids once. The tables are split by the middle word (the last
word of the context), which a trigram, its bigram and both back-off weights have in common; a frequent
one is split again by the word before, and its bigrams go to each share. The documents' trigrams are
dealt to the part of the tables that scores them, packed as columns (about 5 bytes each), and
a part returns one sum per document. This goes in ``ROUNDS`` rounds, each over its share of the parts,
and the shuffle files of a finished step are removed, so that the disk holds a share of them at a time.
No part of the tables passes through the driver, which holds the vocabulary alone.

A document is kept if its log-probability per token reaches the quantile of its
language: ``QUANTILE`` of all documents labelled good that the model was not
trained on (languages with under ``MIN_TRUSTED`` of them use all languages').

Edge cases: a null or empty text has one token (the end); it is judged like any
other. Null languages form one. Repeated documents are judged each alike, ties
with the threshold are kept. Without trusted text nothing is judged: the
probability is null and everything is kept. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import commonest, near_ids, released, stored

SHARD_ROWS = 1_000_000   # trigrams and bigrams of a part of the tables
ROUNDS = 4               # in which the documents' trigrams are dealt out
STEP_WORDS = 1 << 21     # words coded together
HELD_GRAMS = 1 << 21     # trigrams a task counts before it passes them on
SCALE = 1 << 30          # a part's sums are whole numbers of 1 / SCALE: their order does not matter
QUANTILE = 0.005
MIN_TRUSTED = 50
UNKNOWN, BEGIN, FINISH, FIRST_WORD = 0, 1, 2, 3
BITS = 21                # of a word id in a packed n-gram
VOCABULARY = 1 << 20     # words with an id, at most


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents the model is trained on."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.where(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) != 0)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a batch, by the tokeniser that the n-grams and scores use."""
    for b in batches:
        c: Counter = Counter()
        for t in b.column(0):
            c.update(tokens(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(c.values(), pa.int64())], ["w", "n"])


def packed(*columns: np.ndarray) -> bytes:
    """The columns as byte planes (the first bytes of all values, the second, ...), compressed."""
    return pa.compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, *types: type) -> list[np.ndarray]:
    width = [np.dtype(t).itemsize for t in types]
    raw, at, out = pa.decompress(data, n * sum(width), "zstd", asbytes=True), 0, []
    for t, w in zip(types, width):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T).view(t).ravel())
        at += n * w
    return out


def _pack_keys(key: np.ndarray, last: np.ndarray, words: int) -> bytes:
    """Sorted n-grams, each an integer of middle word (first), other words; and a column beside them."""
    mask = (1 << BITS) - 1
    cols = [(key >> BITS * i & mask).astype(np.int32) for i in range(words - 1, -1, -1)]
    cols[0] = np.diff(cols[0], prepend=np.int32(0))
    return packed(*cols, last)


def _unpack_keys(data: bytes, n: int, words: int, last: type) -> tuple[np.ndarray, np.ndarray]:
    *cols, x = unpacked(data, n, *[np.int32] * words, last)
    key = np.cumsum(cols[0], dtype=np.int64)
    for c in cols[1:]:
        key = key << BITS | c
    return key, x


def trigrams(s: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, u, w as one integer; number of the text) of the trigrams of texts between their marks that have one of
    the middle words."""
    end = s == FINISH
    at = np.flatnonzero(middle[s[1:-1]] & (s[2:] != BEGIN))   # what would span two texts is the begin marks after each end
    u, v, w = (s[i:len(s) - 2 + i][at].astype(np.int64) for i in range(3))
    return (v << BITS | u) << BITS | w, (np.cumsum(end, dtype=np.int32) - end)[2:][at].astype(np.int32)


class Parts:
    """Which part of the tables has a context: its middle word says, for frequent ones the word before too. The
    middle word also says in which round it is dealt; every round has ``n`` parts."""

    def __init__(self, seen: np.ndarray, parts: int, rounds: int = 1):
        self.n, self.rounds = math.ceil(parts / rounds), rounds
        share = 2 * seen * parts // max(1, int(seen.sum())) + 1
        share[BEGIN] = 1                     # one word only comes before it
        self.share = np.minimum(share, self.n).astype(np.int32)

    def middle(self, turn: int) -> np.ndarray:
        """Of each word, whether trigrams around it belong to this round."""
        mixed = np.arange(len(self.share), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(48)) % np.uint64(self.rounds) == turn

    def first(self, v: np.ndarray) -> np.ndarray:
        return (v.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.int64) % self.n

    def of(self, key: np.ndarray) -> np.ndarray:
        """The part of each trigram (v, u, w as one integer)."""
        u, v = key >> BITS & (1 << BITS) - 1, key >> 2 * BITS
        own = (u.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)).astype(np.int64) % self.share[v]
        return (self.first(v) + own) % self.n


def _cut(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its rows), in order."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.int16) if part.max() < 1 << 15 else part, kind="stable")
    held = part[order]
    for at in np.split(order, np.flatnonzero(np.diff(held)) + 1):
        yield int(part[at[0]]), at


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of n."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


GRAMS = "part int, kind int, n long, data binary, n1 long, n2 long, n3 long, n4 long"
TRI, BI, SOME, TEXT = 0, 1, 2, 3     # rows of trigrams, bigrams, bigrams of frequent words in part, documents


def _gram_row(part: int, kind: int, key: np.ndarray, n: np.ndarray) -> dict:
    c = np.bincount(np.minimum(n, 5), minlength=6)
    return {"part": part, "kind": kind, "n": len(key), "data": _pack_keys(key, n, 3 if kind == TRI else 2),
            **{f"n{i}": int(c[i]) for i in (1, 2, 3, 4)}}


_GRAMS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("data", pa.binary()),
                    *[(f"n{i}", pa.int64()) for i in (1, 2, 3, 4)]])


def _coded(texts: Iterator, get: Callable, step: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Word ids between their marks of some texts at a time, and their token counts."""
    own, n, held = [], [], 0
    for t in texts:
        s = [BEGIN, BEGIN, *[get(w, UNKNOWN) for w in tokens(t.as_py())], FINISH]
        own.append(np.array(s, dtype=np.int32))
        n.append(len(s) - 2)
        held += len(s)
        if held >= step:
            yield np.concatenate(own), n
            own, n, held = [], [], 0
    if own:
        yield np.concatenate(own), n


def _grams(ids: dict[str, int]):
    """Counted trigrams of the texts."""
    step, every = HELD_GRAMS, np.ones(len(ids) + FIRST_WORD, dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _ in _coded((t for b in batches for t in b.column(0)), ids.get, step):
            key, n = np.unique(trigrams(s, every)[0], return_counts=True)
            v, u, w = (key >> BITS * i & (1 << BITS) - 1 for i in (2, 1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, w, n)], ["u", "v", "w", "n"])
    return run


def _deal_grams(ids: dict[str, int], parts: Parts):
    """Counted trigrams of the texts, packed for the parts."""
    count = _grams(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in count(batches):
            u, v, w, n = (x.to_numpy() for x in b.columns)
            key = (v << BITS | u) << BITS | w
            for p, at in _cut(parts.of(key)):
                yield pa.RecordBatch.from_pylist([_gram_row(p, TRI, key[at], n[at])], _GRAMS)
    return run


def _merge(kind: int, share: np.ndarray | None):
    """The rows of a part as one; those of trigrams give the bigrams too (after the
    begin mark there is one history only, so plain counts are used)."""
    def run(t: pa.Table) -> pa.Table:
        words = 3 if kind == TRI else 2
        rows = [_unpack_keys(d.as_py(), n.as_py(), words, np.int64) for d, n in zip(t["data"], t["n"])]
        part = t["part"][0].as_py()
        key, n = _summed(*map(np.concatenate, zip(*rows)))
        out = [_gram_row(part, kind, key, n)]
        if kind == TRI:
            vw = key >> 2 * BITS << BITS | key & (1 << BITS) - 1
            vw, n = _summed(vw, np.where(key >> 2 * BITS == BEGIN, n, 1))
            split = share[vw >> BITS] > 1
            out += [_gram_row(part, k, vw[at], n[at]) for k, at in ((SOME, split), (BI, ~split)) if at.any()]
        return pa.Table.from_pylist(out, _GRAMS)
    return run


def _deal_some(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows in zip(b["data"], b["n"]):
                key, n = _unpack_keys(d.as_py(), rows.as_py(), 2, np.int64)
                spot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
                for p, at in _cut(spot % parts):
                    yield pa.RecordBatch.from_pylist([_gram_row(p, SOME, key[at], n[at])], _GRAMS)
    return run


def _lasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n) of the bigrams in a row, n their number."""
    for b in batches:
        for d, rows in zip(b["data"], b["n"]):
            key, _ = _unpack_keys(d.as_py(), rows.as_py(), 2, np.int64)
            w, n = np.unique(key & (1 << BITS) - 1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], ["w", "n"])


def discounts(n: list[int]) -> list[float]:
    """Discount of counts 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    n = [0, *n]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i
        out.append(min(max(d, 0.05), i - 0.05))
    return out


def held_back(n: np.ndarray, d: list[float]) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *d])[np.minimum(n, 3)]


def _contexts(key: np.ndarray, n: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts (keys ascending) with back-off weight, place of each row's context, and its total."""
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(first):
        return key, np.zeros(0), first, np.zeros(0)
    total = np.add.reduceat(n, first)
    at = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))
    return key[first], np.add.reduceat(held_back(n, d), first) / total, at, total[at]


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model: packed counts of trigrams and bigrams (a DataFrame), the ids, and
    what every part needs to make probabilities of its counts."""
    mine = trusted_ids(labels).withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text"))
    texts = near_ids(texts, "_doc", mine)
    # the ids are distinct; a semi join would be moved before the filter of near_ids, and deal out all texts
    trusted = texts.join(mine.hint("merge"), F.col("_doc") == F.col("_id")).select("text")
    words = trusted.mapInArrow(_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    words = stored(words, "trusted-words")
    listed = commonest(words.where("n > 1").withColumnRenamed("w", "word"), VOCABULARY)
    ids = {w: i + FIRST_WORD for i, w in enumerate(listed)}
    every = words.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).first()
    seen = np.array([0, 0, 0, *listed.values()], dtype=np.int64)
    del listed
    seen[UNKNOWN] = (every["n"] or 0) - seen.sum()
    parts = Parts(seen, max(1, math.ceil(seen.sum() / SHARD_ROWS)))
    grams = stored(trusted.mapInArrow(_deal_grams(ids, parts), GRAMS).groupBy("part")
                   .applyInArrow(_merge(TRI, parts.share), GRAMS), "grams")
    if grams.isEmpty():
        return None
    whole = grams.where(F.col("kind") != SOME)
    if (parts.share > 1).any():
        some = stored(grams.where(F.col("kind") == SOME).mapInArrow(_deal_some(parts.n), GRAMS)
                      .groupBy("part").applyInArrow(_merge(BI, None), GRAMS), "bigrams")
        whole = whole.union(some)
    counts = {r["kind"]: r for r in whole.groupBy("kind").agg(
        F.sum("n").alias("n"), *[F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()}
    d2, d3 = (discounts([counts[k][f"n{i}"] for i in (1, 2, 3, 4)]) for k in (BI, TRI))
    uni = whole.where(F.col("kind") == BI).mapInArrow(_lasts, "w long, n long").groupBy("w").agg(
        F.sum("n").alias("n")).toArrow()                                    # at most the vocabulary
    w, n = uni["w"].to_numpy(), uni["n"].to_numpy()
    d1 = discounts([int((n == i).sum()) for i in (1, 2, 3, 4)])
    floor = held_back(n, d1).sum() / n.sum() / (len(ids) + 2)
    p1 = np.full(len(ids) + FIRST_WORD, floor)
    p1[w] = (n - held_back(n, d1)) / n.sum() + floor
    return {"ids": ids, "seen": seen, "grams": whole.select("kind", "n", "data"),
            "rows": sum(r["n"] for r in counts.values()),
            "head": {"p1": p1, "d2": d2, "d3": d3, "unknown": math.log10(every["words"] - len(ids) + 1)}}


class Shard:
    """Sorted arrays of one shard's log-probabilities and back-off weights."""

    def __init__(self, model: dict, shard: int, shards: int):
        rows: dict[int, list] = {TRI: [], BI: []}
        for r in model["grams"].toLocalIterator():
            words = 3 if r["kind"] == TRI else 2
            key, n = _unpack_keys(r["data"], r["n"], words, np.int64)
            at = (key >> (words - 1) * BITS) % shards == shard
            rows[r["kind"]].append((key[at], n[at]))
        self._fill(model["head"], rows[TRI], rows[BI])

    @classmethod
    def of(cls, head: dict, tri: list, bi: list) -> Shard:
        """From the (key, n) of its trigrams and bigrams."""
        s = cls.__new__(cls)
        s._fill(head, tri, bi)
        return s

    def _fill(self, head: dict, tri: list, bi: list) -> None:
        none = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        (k3, n3), (k2, n2) = (_summed(*map(np.concatenate, zip(*(x or none)))) for x in (tri, bi))
        mask = (1 << BITS) - 1
        v, back, at, total = _contexts(k2 >> BITS, n2, head["d2"])
        p2 = (n2 - held_back(n2, head["d2"])) / total + back[at] * head["p1"][k2 & mask]
        self.g2 = v, np.log10(back).astype(np.float32)
        self.p2 = k2, np.log10(p2).astype(np.float32)
        vu, back, at, total = _contexts(k3 >> BITS, n3, head["d3"])
        low = p2[np.searchsorted(k2, k3 >> 2 * BITS << BITS | k3 & mask)] if len(k3) else np.zeros(0)
        p3 = (n3 - held_back(n3, head["d3"])) / total + back[at] * low
        self.g3 = vu, np.log10(back).astype(np.float32)
        self.p3 = k3, np.log10(p3).astype(np.float32)
        self.p1 = np.log10(head["p1"]).astype(np.float32)
        self.unknown = head["unknown"]
        self.own = np.zeros(len(self.p1), dtype=bool)           # middle words that belong to this shard
        self.own[v] = True
        self.known = self.own                                   # middle words of any shard

    @staticmethod
    def _get(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key; the value is 0 where it is not found."""
        keys, x = table
        if not len(keys):
            return np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=np.float32)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        found = keys[at] == key
        return found, np.where(found, x[at], np.float32(0))

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, first: bool) -> np.ndarray:
        """Log-probability of each word w after u, v; 0 for those of other
        shards. Words after a v that is no context belong to the first shard."""
        mine = self.own[v] | ~self.known[v] if first else self.own[v]
        at = slice(None) if mine.all() else np.flatnonzero(mine)
        u, v, w = u[at], v[at], w[at]
        vw, vu = v << BITS | w, v << BITS | u
        has2, low = self._get(self.p2, vw)
        no2 = np.flatnonzero(~has2)
        low[no2] = self._get(self.g2, v[no2])[1] + self.p1[w[no2]]
        # a trigram is in the model only if its bigram is
        tri = np.flatnonzero(has2)
        has3, p3 = self._get(self.p3, vu[tri] << BITS | w[tri])
        backed = np.ones(len(low), dtype=bool)
        backed[tri[has3]] = False
        rest = np.flatnonzero(backed)
        low[rest] += self._get(self.g3, vu[rest])[1]
        low[tri[has3]] = p3[has3]
        low[w == UNKNOWN] -= self.unknown
        out = np.zeros(len(mine))
        out[at] = low
        return out


DEALT = "part int, kind int, chunk long, docs int, n long, data binary"
_DEALT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("docs", pa.int32()),
                    ("n", pa.int64()), ("data", pa.binary())])
SUMS = "chunk long, docs int, data binary"
_SUMS = pa.schema([("chunk", pa.int64()), ("docs", pa.int32()), ("data", pa.binary())])
_SCORES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_tokens", pa.int64()),
                     ("log10_prob", pa.float64())])


def _dealt_row(part: int, kind: int, chunk: int, docs: int, key: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part, "kind": kind, "chunk": chunk, "docs": docs, "n": len(key),
                                        "data": _pack_keys(key, last, 2 if kind == BI else 3)}], _DEALT)


def _deal_model(parts: Parts, turn: int):
    """The tables' rows to the parts of this round; bigrams of frequent middle words to each share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = parts.middle(turn)
        for b in batches:
            for k, rows, d in zip(b["kind"].to_pylist(), b["n"].to_pylist(), b["data"]):
                words = 3 if k == TRI else 2
                key, n = _unpack_keys(d.as_py(), rows, words, np.int64)
                v = key >> (words - 1) * BITS
                now = middle[v]
                key, n, v = key[now], n[now], v[now]
                if k == TRI:
                    at, part = np.arange(len(key)), parts.of(key)
                else:
                    share = parts.share[v].astype(np.int64)
                    at = np.repeat(np.arange(len(key)), share)
                    part = (parts.first(v)[at] + np.arange(len(at)) - np.repeat(np.cumsum(share) - share, share)) % parts.n
                for p, mine in _cut(part):
                    yield _dealt_row(p, k, -1, 0, key[at[mine]], n[at[mine]])
    return run


def _deal_texts(parts: Parts, turn: int):
    """The documents' trigrams that this round scores, with the document's number in its chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = parts.middle(turn)
        for b in batches:
            for chunk, n, length, d in zip(b["chunk"].to_pylist(), b["docs"].to_pylist(), b["n"].to_pylist(), b["data"]):
                key, doc = trigrams(unpacked(d.as_py(), length, np.int32)[0], middle)
                order = np.argsort(key)
                key, doc = key[order], doc[order]
                for p, at in _cut(parts.of(key)):
                    yield _dealt_row(p, TEXT, chunk, n, key[at], doc[at])
    return run


def _part_sums(head: dict):
    """Sums by document of the log-probabilities of a part's trigrams; the part's tables come first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tables, shard, mask = None, {TRI: [], BI: []}, None, (1 << BITS) - 1
        for b in batches:
            for p, k, chunk, docs, n, d in zip(*[b.column(i).to_pylist() for i in range(5)], b.column(5)):
                if p != part:
                    part, tables, shard = p, {TRI: [], BI: []}, None
                if k != TEXT:
                    tables[k].append(_unpack_keys(d.as_py(), n, 3 if k == TRI else 2, np.int64))
                    continue
                if shard is None:
                    shard, tables = Shard.of(head, tables[TRI], tables[BI]), {}
                key, doc = _unpack_keys(d.as_py(), n, 3, np.int32)
                x = shard.log10(key >> BITS & mask, key >> 2 * BITS, key & mask, True)
                x = np.rint(np.bincount(doc, x, docs) * SCALE).astype(np.int64)
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "docs": docs, "data": packed(x)}], _SUMS)
    return run


def _add(t: pa.Table) -> pa.Table:
    """The sums of a chunk over several parts."""
    x = sum(unpacked(d.as_py(), n.as_py(), np.int64)[0] for d, n in zip(t["data"], t["docs"]))
    return pa.Table.from_pylist([{"chunk": t["chunk"][0].as_py(), "docs": len(x), "data": packed(x)}], _SUMS)


def _scores(t: pa.Table, sums: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of all rounds."""
    x = sum(unpacked(d.as_py(), n.as_py(), np.int64)[0] for d, n in zip(sums["data"], sums["docs"]))
    cols = [t.column(c).combine_chunks().flatten() for c in ("row", "doc_id", "lang", "n_tokens")]
    return pa.Table.from_arrays([*cols, pa.array(x / SCALE)], schema=_SCORES)


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(row, doc_id, lang, n_tokens, log10_prob) of every document."""
    src = docs.select(F.col(f"`{text}`").cast("string").alias("text"),
                      F.monotonically_increasing_id().alias("row"),
                      F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                      F.col(f"`{lang}`").cast("string").alias("lang"))
    ids, head, step = model["ids"], model["head"], STEP_WORDS
    n_parts = max(1, math.ceil(model["rows"] / shard_rows))
    rounds = min(ROUNDS, n_parts)
    parts = Parts(model["seen"], n_parts, rounds)
    info = pa.schema([("chunk", pa.int64()), ("docs", pa.int32()), ("n", pa.int64()), ("data", pa.binary()),
                      ("row", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())),
                      ("n_tokens", pa.list_(pa.int64()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Some texts at a time as word ids between their marks."""
        held: list[list] = [[], [], []]

        def texts() -> Iterator:
            for b in batches:
                for t, *own in zip(b.column(0), *[b.column(i).to_pylist() for i in (1, 2, 3)]):
                    for h, x in zip(held, own):
                        h.append(x)
                    yield t

        for s, n in _coded(texts(), ids.get, step):
            row = {"chunk": held[0][0], "docs": len(n), "n": len(s), "data": packed(s), "row": held[0][:],
                   "doc_id": held[1][:], "lang": held[2][:], "n_tokens": n}
            for h in held:
                h.clear()
            yield pa.RecordBatch.from_pylist([row], info)

    coded = stored(src.mapInArrow(encode, "chunk long, docs int, n long, data binary, row array<long>, "
                                          "doc_id array<long>, lang array<string>, n_tokens array<long>"), "word-ids")
    sums = []
    for turn in range(rounds):
        dealt = model["grams"].mapInArrow(_deal_model(parts, turn), DEALT).union(
            coded.select("chunk", "docs", "n", "data").mapInArrow(_deal_texts(parts, turn), DEALT))
        own = dealt.repartitionById(parts.n, "part").sortWithinPartitions("part", "kind")
        sums.append(stored(own.mapInArrow(_part_sums(head), SUMS).groupBy("chunk").applyInArrow(_add, SUMS), "sums"))
    return coded.select("chunk", "row", "doc_id", "lang", "n_tokens").groupBy("chunk").cogroup(
        reduce(DataFrame.union, sums).groupBy("chunk")).applyInArrow(
            _scores, "row long, doc_id long, lang string, n_tokens long, log10_prob double")


def classify(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, lang, n_tokens, log10_prob, perplexity, threshold, kept)."""
    with released(docs.sparkSession):
        return _classify(docs, labels, shard_rows)


def _classify(docs: DataFrame, labels: DataFrame, shard_rows: int) -> DataFrame:
    model = fit(docs, labels)
    if model is None:
        return docs.select("doc_id", "lang", F.lit(None).cast("long").alias("n_tokens"),
                           *[F.lit(None).cast("double").alias(c) for c in ("log10_prob", "perplexity", "threshold")],
                           F.lit(True).alias("kept"))
    rows = stored(score(docs, model, shard_rows=shard_rows)
                  .withColumn("per_token", F.col("log10_prob") / F.col("n_tokens")), "perplexity")
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_id")).distinct()
    trained = trusted_ids(labels).withColumnRenamed("doc_id", "_id")
    fresh = (rows.join(good, F.col("doc_id") == F.col("_id"), "left_semi")
             .join(trained, F.col("doc_id") == F.col("_id"), "left_anti"))
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("!"))
    cut = F.percentile_approx("per_token", QUANTILE, 10_000)
    every = fresh.agg(cut.alias("cut")).first()["cut"]
    by_lang = stored(fresh.groupBy(key.alias("key")).agg(cut.alias("cut"), F.count(F.lit(1)).alias("n"))
                     .where(F.col("n") >= MIN_TRUSTED).select("key", "cut"), "quantiles")
    judged = rows.withColumn("key", key).join(by_lang, "key", "left").withColumn(
        "threshold", F.coalesce("cut", F.lit(every).cast("double")))
    return judged.select(
        "doc_id", "lang", "n_tokens", "log10_prob", F.pow(F.lit(10.0), -F.col("per_token")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.col("threshold")).alias("threshold"),
        F.coalesce(F.col("per_token") >= F.col("threshold"), F.lit(True)).alias("kept"))
