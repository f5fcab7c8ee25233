"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by an item if some stretch of it is within a word
edit distance of ``MAX_EDITS`` of the item's length (similarity 0.8 or more;
words are lower-cased letter and digit runs).

For every item length, windows of that many words go over the whole document.
The CGK random walk turns a sequence into a longer one such that a small edit
distance becomes a small Hamming distance: at step j it writes the current
symbol and moves on or stays by a random bit of (j, symbol), a hash computed as
the walk goes. Sampling a few written positions is then an LSH for edit distance;
for each item length it is repeated with fresh walks until the recall, measured on
edited items of that length, reaches ``RECALL``. Every colliding (window, item) is
checked by the exact edit distance to the best stretch around the window.

Windows that cannot match are left out first, without loss: a window within k
edits of an item has at most k words foreign to the items of its length.

Items are a broadcast of bounded size: ``BLOCK_CHARS`` characters of distinct
item texts at a time, as many blocks (passes) as the benchmark needs. A block is
loaded when its pass begins; what passes find is written before the next. A walk
keeps its steps' multipliers and a hash and a number per item, no table by symbol.

Edge cases: null, empty or wordless texts and items match nothing. Items with
equal texts are all reported. Repeated documents are reported each. A null
doc_id or item_id stays null in the report. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import stored

MAX_EDITS = 0.2          # of the item's words
RECALL = 0.99            # of the LSH, at the largest edit distance
TRIALS = 100             # edited items per length that the recall is measured on
BLOCK_CHARS = 8_000_000  # item text that is broadcast at once
STEP_WORDS = 1 << 21     # words of documents worked on together
MASKS = 2_000            # items whose bit masks a task holds at once
SEED = 7
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edits_allowed(length: int) -> int:
    return int(MAX_EDITS * length + 1e-9)


def substring_distance(masks: dict[int, int], length: int, seq: list[int]) -> int:
    """Least edit distance of an item (bit masks by symbol) to any stretch of
    ``seq`` (Myers' bit-vector algorithm)."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    pv, mv, score = full, 0, length
    best = score
    for c in seq:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        best = min(best, score)
    return best


def symbol_hashes(length: int, symbols: int) -> np.ndarray:
    """A random odd word for each of the symbols 0 to ``symbols``."""
    rng = np.random.default_rng((SEED, length, symbols))
    return rng.integers(0, 1 << 32, symbols + 1, dtype=np.uint32) | np.uint32(1)


class Walk:
    """One repetition of the LSH for sequences of ``length`` symbols: a position
    sampled from the first quarter of the walk, where most windows drop out
    early, and one from its second half. The random bit of (step, symbol) is the
    top bit of the symbol's hash times the step's odd multiplier."""

    def __init__(self, length: int, symbols: int, seed: tuple[int, ...]):
        rng = np.random.default_rng(seed)
        self.at = int(rng.integers(max(1, length // 2))), int(length + rng.integers(length))
        self.factors = rng.integers(0, 1 << 32, self.at[1] + 1, dtype=np.uint32) | np.uint32(1)
        self.symbols = symbols

    def keys(self, flat: np.ndarray, hashes: np.ndarray, start: np.ndarray, length: int,
             first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the windows of ``flat`` (``hashes`` of its symbols) at
        ``start``; windows whose first sampled symbol is not in ``first`` (a mask by
        symbol) can meet no item and are left out. ``flat`` goes on for one symbol
        after the last window at least."""
        row = np.arange(len(start), dtype=np.int32)
        at = start.astype(np.int32)
        end = at + np.int32(length)
        for j, factor in enumerate(self.factors):
            past = at >= end if j >= length else None      # no walk is past its window before
            if j in self.at:
                symbol = flat[at]
                if past is not None:
                    symbol[past] = -1
                if j == self.at[1]:
                    return row, sampled * (self.symbols + 2) + symbol + 1
                if first is not None:
                    keep = first[symbol]
                    row, at, end, symbol = row[keep], at[keep], end[keep], symbol[keep]
                sampled = symbol.astype(np.int64)
            step = ((hashes[at] * factor) >> np.uint32(31)).view(np.int32)
            if j >= length:
                step[past] = 0
            at += step
        raise AssertionError


class Items:
    """The items of one block, ready for search."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.ids: dict[str, int] = {}
        by_text: dict[tuple[int, ...], list] = defaultdict(list)
        for key, text in rows:
            seq = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in tokens(text))
            if seq:
                by_text[seq].append(key)
        lengths = defaultdict(list)
        for seq, own in by_text.items():
            lengths[len(seq)].append((seq, own))
        self.groups = [self._group(n, lengths[n]) for n in sorted(lengths)]
        self.pad = max(lengths, default=0)
        self.masks: dict[tuple[int, int], dict[int, int]] = {}

    def _group(self, n: int, items: list) -> dict:
        """Items of ``n`` words. Their words are numbered anew from 1, so the
        walks' tables stay small; 0 is any other word."""
        k = edits_allowed(n)
        words, seqs = np.unique(np.array([s for s, _ in items], dtype=np.int32), return_inverse=True)
        seqs = seqs.reshape(len(items), n).astype(np.int32) + 1
        hashes = symbol_hashes(n, len(words))
        walks = []
        flat, start = np.r_[seqs.ravel(), np.int32(0)], np.arange(len(seqs)) * n
        for w in self._walks(n, k, seqs, hashes):
            _, keys = w.keys(flat, hashes[flat], start, n)
            order = np.argsort(keys, kind="stable")
            walks.append((w, keys[order], order.astype(np.int32)))
        return {"n": n, "k": k, "words": words, "seqs": seqs, "walks": walks, "items": [o for _, o in items]}

    def _walks(self, n: int, k: int, seqs: np.ndarray, hashes: np.ndarray) -> Iterator[Walk]:
        """Walks until a share RECALL of TRIALS items with k random edits each has
        met its item in one of them."""
        rng = np.random.default_rng((SEED, n))
        a, b = [], []
        for t in range(TRIALS):
            s = seqs[t % len(seqs)].tolist()
            e = list(s)
            for _ in range(k):
                i, kind = int(rng.integers(len(e))), int(rng.integers(3))
                if kind == 0:
                    e[i] = 0
                elif kind == 1:
                    e.insert(i, 0)
                else:
                    del e[i]
            a += s
            b += (e + [0] * n)[:n]
        a, b = np.array(a + [0], np.int32), np.array(b + [0], np.int32)
        start = np.arange(TRIALS) * n
        both, starts = np.r_[a, b], np.r_[start, start + len(a)]
        met, r = np.zeros(TRIALS, dtype=bool), 0
        while met.mean() < RECALL:
            w = Walk(n, len(hashes) - 1, (SEED, n, r))
            keys = w.keys(both, hashes[both], starts, n)[1]
            met |= keys[:TRIALS] == keys[TRIALS:]
            r += 1
            yield w

    def _mask(self, g: dict, i: int) -> dict[int, int]:
        """Bit masks by symbol of an item, made when it is first checked."""
        found = self.masks.get((g["n"], i))
        if found is None:
            if len(self.masks) >= MASKS:
                self.masks.clear()
            found = self.masks[g["n"], i] = {}
            for at, c in enumerate(g["seqs"][i].tolist()):
                found[c] = found.get(c, 0) | 1 << at
        return found

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, str, int, int]]:
        """(document, item key, edits, item words) of every match."""
        if not self.groups:
            return
        get = self.ids.get
        held: list[tuple[int, list[int]]] = []
        size = 0
        for d, t in enumerate(texts):
            seq = [get(w, 0) for w in tokens(t)]
            if any(seq):
                held.append((d, seq))
                size += len(seq) + self.pad
            if size >= STEP_WORDS:
                yield from self._search(held)
                held, size = [], 0
        if held:
            yield from self._search(held)

    def _search(self, docs: list[tuple[int, list[int]]]) -> Iterator[tuple[int, str, int, int]]:
        gap = [0] * (self.pad + 1)               # no window spans two documents with words of both
        flat, begin = [], []
        for _, seq in docs:
            begin.append(len(flat))
            flat += seq
            flat += gap
        begin.append(len(flat))
        every, begin = np.array(flat, dtype=np.int32), np.array(begin)
        for g in self.groups:
            n, k = g["n"], g["k"]
            local = np.zeros(len(self.ids) + 1, dtype=np.int32)
            local[g["words"]] = np.arange(1, len(g["words"]) + 1)
            flat = local[every]
            foreign = np.zeros(len(flat) + 1, dtype=np.int32)
            np.cumsum(flat == 0, dtype=np.int32, out=foreign[1:])
            start = np.flatnonzero(foreign[n:-1] - foreign[:-n - 1] <= k)
            if not len(start):
                continue
            pairs = []
            hashes = symbol_hashes(n, len(g["words"]))[flat]
            for walk, keys, order in g["walks"]:
                first = np.zeros(len(g["words"]) + 1, dtype=bool)
                first[keys // (len(g["words"]) + 2)] = True
                row, found = walk.keys(flat, hashes, start, n, first)
                low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                hit = np.flatnonzero(high > low)
                if len(hit):
                    m = high[hit] - low[hit]
                    step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    pairs.append(np.unique(np.repeat(start[row[hit]], m) * len(order)
                                           + order[np.repeat(low[hit], m) + step]))
            if not pairs:
                continue
            cand = np.unique(np.concatenate(pairs))
            where, item = cand // len(g["items"]), cand % len(g["items"])
            doc = np.searchsorted(begin, where, "right") - 1
            best: dict[tuple[int, int], int] = {}
            seen: dict[tuple[int, int], int] = {}
            for s, i, d in zip(where.tolist(), item.tolist(), doc.tolist()):
                if best.get((d, i)) == 0:
                    continue
                # one check looks k words to either side, so it also covers the next k starts
                if s <= seen.get((d, i), -1):
                    continue
                seen[d, i] = s + k
                low = max(begin[d], s - k)
                high = min(begin[d + 1] - self.pad - 1, s + 2 * k + n)
                e = substring_distance(self._mask(g, i), n, flat[low:high].tolist())
                if e <= k and e < best.get((d, i), k + 1):
                    best[d, i] = e
            for (d, i), e in best.items():
                for key in g["items"][i]:
                    yield docs[d][0], key, e, n


def item_texts(items: DataFrame, text: str) -> DataFrame:
    """(key, t): the distinct item texts and a digest of each."""
    t = items.select(F.col(f"`{text}`").cast("string").alias("t")).where(F.length("t") > 0)
    return t.distinct().select(F.sha2("t", 256).alias("key"), "t")


def item_blocks(texts: DataFrame) -> list[DataFrame]:
    """Distinct item texts in blocks of at most about BLOCK_CHARS characters, each
    read on its own; the sizes are measured first."""
    total = texts.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / BLOCK_CHARS))
    return [texts.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b) for b in range(n)]


def _load(block: DataFrame) -> Items:
    return Items(sorted(((r["key"], r["t"]) for r in block.collect()), key=lambda r: r[1]))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, item_words, similarity) of every contaminated
    document and the item found in it."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                      F.col(f"`{text}`").cast("string").alias("text"))

    def searcher(found: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(found.search(b.column(1).to_pylist()))
                ids = b.column(0)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([1 - r[2] / r[3] for r in rows], pa.float64())],
                    ["doc_id", "key", "edits", "item_words", "similarity"])
        return src.mapInArrow(run, "doc_id long, key string, edits long, item_words long, similarity double")

    blocks = item_blocks(item_texts(items, item_text))
    if len(blocks) == 1:
        found = searcher(_load(blocks[0]))
    else:
        found = reduce(DataFrame.union, [stored(searcher(_load(b)), "item-matches") for b in blocks])
    known = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"),
                         F.sha2(F.col(f"`{item_text}`").cast("string"), 256).alias("key"))
    return found.join(known, "key").select("doc_id", "item_id", "edits", "item_words", "similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text",
                      item_text: str = "text") -> DataFrame:
    """The documents that no item is found in, all columns."""
    at = docs.columns.index(text)

    def cleaner(found: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, dtype=bool)
                clean[[r[0] for r in found.search(b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(clean))
        return run

    blocks = item_blocks(item_texts(items, item_text))
    for n, b in enumerate(blocks):
        docs = docs.mapInArrow(cleaner(_load(b)), docs.schema)
        if n < len(blocks) - 1:
            docs = stored(docs, "clean")
    return docs
