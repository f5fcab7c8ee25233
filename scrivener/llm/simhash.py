"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints (64 bits, over word shingles) that differ in at most
``MAX_BITS`` bits are linked; groups are the connected components.

1. The 64 bits are cut into n blocks, n > MAX_BITS. Two linked fingerprints
   agree on n - MAX_BITS blocks at least, so each distinct fingerprint goes to
   one bucket per choice of that many blocks (exact: no link is lost). n grows
   with the number of fingerprints (``block_count``), so that a bucket of
   unrelated ones stays within an index: 5 keys of 12 bits up to 16 million
   fingerprints, 15 of 21 bits up to 8 thousand million, then 35 of 27.
2. Buckets are sorted by the Gray rank of the fingerprint. Neighbours in that
   order differ in few bits, so runs of rows share masked bit patterns: each
   run of ``FANOUT`` rows gets a parent holding the bits all of them share,
   runs of parents get parents, and a bit shared higher up is left out below.
3. A query walks the tree from the top, adding up the differences on each
   node's own shared bits; a whole group is dropped once the sum exceeds
   MAX_BITS. What reaches the leaves is linked: at a leaf all bits count.

A bucket larger than ``CHUNK`` rows (a hot bit pattern) is a run of chunks. The
chunks' patterns are compared first, the same way; each surviving pair of
chunks is a task of its own. Links leave a task as a spanning forest (at most
one row per fingerprint), never as all pairs.

Edge cases: a null, empty or blank text has no words and fingerprint zero,
linked like any other. A text with fewer words than a shingle is one shingle.
Equal texts share a fingerprint, hence a group. A null doc_id stays in the
result; it names a group only if all ids of the group are null (then null).
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.llm.common import fresh, slots, stored
from scrivener.llm.components import components

SHINGLE = 4          # words in a shingle
MAX_BITS = 4         # fingerprints link at this many differing bits or fewer
SEED = 42
CHUNK = 4096         # fingerprints that one index holds
FANOUT = 8           # children of a node
FRONTIER = 1 << 18   # (query, node) pairs looked at together


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text, over all its word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # ASCII case and space
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(p, SEED) for p in parts], dtype=np.uint64)
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        bits += np.unpackbits(h[i:i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big")


def add_fingerprint(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed long column."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))],
                                             [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


# ---------------------------------------------------------- the index in a task

def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    x = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def shared_bits(ones: np.ndarray, some: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """AND and OR over runs of rows that begin at ``start``."""
    return np.bitwise_and.reduceat(ones, start), np.bitwise_or.reduceat(some, start)


class GrayIndex:
    """Tree over fingerprints in Gray order (``fp`` sorted already); ``bucket``
    labels runs of rows that never meet, each with a root of its own."""

    def __init__(self, fp: np.ndarray, bucket: np.ndarray):
        ones, some, group = fp, fp, bucket
        levels = []          # leaves first: (fixed bits, value, first child, children)
        child = np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64)
        levels.append((~(ones ^ some), ones, *child))
        while True:
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            run = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(group)]))
            start = np.flatnonzero((np.arange(len(group)) - edge[run]) % FANOUT == 0)
            if len(start) == len(group):
                break
            n = np.diff(np.r_[start, len(group)])
            ones, some = shared_bits(ones, some, start)
            group = group[start]
            levels.append((~(ones ^ some), ones, start, n))
        self.levels = levels
        self.roots = group

    def links(self, query: np.ndarray, q_bucket: np.ndarray, radius: int
              ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, leaf row) with at most ``radius`` differing bits."""
        rows = np.flatnonzero(np.isin(q_bucket, self.roots))
        node = np.searchsorted(self.roots, q_bucket)
        top = len(self.levels) - 1
        todo = []
        for i in range(0, len(rows), FRONTIER):
            q = rows[i:i + FRONTIER]
            todo.append((top, q, node[q], np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint64)))
        while todo:
            level, q, v, sofar, seen = todo.pop()
            fixed, value, first, n = self.levels[level]
            own = fixed[v] & ~seen                     # bits not counted further up
            sofar = sofar + np.bitwise_count((query[q] ^ value[v]) & own)
            near = sofar <= radius
            q, v, sofar, seen = q[near], v[near], sofar[near], fixed[v[near]]
            if level == 0:
                if len(q):
                    yield q, v
                continue
            for i in range(0, len(q), FRONTIER // FANOUT):
                part = slice(i, i + FRONTIER // FANOUT)
                k = n[v[part]]
                total = int(k.sum())
                step = np.arange(total) - np.repeat(np.cumsum(k) - k, k)
                todo.append((level - 1, np.repeat(q[part], k), np.repeat(first[v[part]], k) + step,
                             np.repeat(sofar[part], k), np.repeat(seen[part], k)))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row reachable from each of ``n`` rows, folding links in as they come."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root != (up := root[root])).any():
                root = up
    return root


def _forest_edges(fp: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})


# ------------------------------------------------------------- over the cluster

def block_keys(radius: int, n: int) -> list[tuple[tuple[int, int], ...]]:
    """The choices of ``n`` - radius of the ``n`` blocks, each block as (shift, width)."""
    ends = [64 * i // n for i in range(n + 1)]
    return list(combinations([(a, b - a) for a, b in zip(ends, ends[1:])], n - radius))


def block_count(rows: int, radius: int, chunk: int = CHUNK) -> int:
    """Fewest blocks whose keys spread ``rows`` fingerprints over buckets of
    ``chunk`` rows on average (``radius`` + 4 blocks at most)."""
    n = radius + 1
    while n < radius + 4 and rows > chunk << min(sum(w for _, w in k) for k in block_keys(radius, n)):
        n += 1
    return n


def bucket_of(fp: Column, index: int, key: tuple[tuple[int, int], ...]) -> Column:
    """Bucket of a fingerprint under one key: the key's number, then its bits."""
    out = F.lit(0).cast("long")
    for shift, width in key:
        out = F.shiftleft(out, width) + F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)
    return out + F.lit(index << 48)


_CHUNKED = "kind int, bucket long, chunk long, fp long, ones long, some long"


def _chunks(radius: int, size_: int):
    """A sorted partition cut into chunks; links inside each chunk. Emits edges
    (kind 0) and, for chunks that may not be the whole of their bucket, the
    chunk's shared bits (kind 1) and its rows (kind 2)."""
    from pyspark import TaskContext

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: list[pd.DataFrame] = []
        state = {"chunk": 0, "last": None, "first": None}

        def solve(rows: pd.DataFrame, end: bool) -> Iterator[pd.DataFrame]:
            bucket = rows["bucket"].to_numpy()
            fp = rows["fp"].to_numpy().view(np.uint64)
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.diff(np.r_[edge, len(bucket)])
            inside = np.arange(len(bucket)) - np.repeat(edge, size)
            new = (inside % size_) == 0
            chunk = np.cumsum(new) - 1
            root = forest(len(fp), GrayIndex(fp, chunk).links(fp, chunk, radius))
            edges = _forest_edges(fp, root)
            if len(edges):
                yield pd.DataFrame({"kind": 0, "bucket": edges["a"], "chunk": edges["b"],
                                    "fp": 0, "ones": 0, "some": 0})
            if state["first"] is None:
                state["first"] = bucket[0]
            # a bucket may go on elsewhere if it is split here or touches the partition's ends
            count = np.repeat(size, size)
            open_ = (count > size_) | (bucket == state["first"]) | (bucket == state["last"])
            open_ |= (bucket == bucket[-1]) if end else False
            if open_.any():
                ids = (np.int64(part) << 32) + state["chunk"] + chunk
                start = np.flatnonzero(new)
                ones, some = shared_bits(fp, fp, start)
                at = open_[start]
                yield pd.DataFrame({"kind": 1, "bucket": bucket[start][at], "chunk": ids[start][at], "fp": 0,
                                    "ones": ones[at].view(np.int64), "some": some[at].view(np.int64)})
                yield pd.DataFrame({"kind": 2, "bucket": bucket[open_], "chunk": ids[open_],
                                    "fp": fp[open_].view(np.int64), "ones": 0, "some": 0})
            state["chunk"] += int(chunk[-1]) + 1

        rows = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            rows += len(b)
            if rows < 16 * size_:
                continue
            all_ = pd.concat(held, ignore_index=True)
            last = all_["bucket"].iloc[-1]
            cut = int(np.searchsorted(all_["bucket"].to_numpy(), last))      # where its last bucket begins
            if cut == 0 or len(all_) - cut >= 4 * size_:     # one bucket fills the buffer
                whole = cut + (len(all_) - cut) // size_ * size_
                yield from solve(all_.iloc[:whole], False)
                # only now: these rows may begin with the rest of the bucket split
                # before, and those of this one are over a chunk, so open as they are
                state["last"] = last
                held = [all_.iloc[whole:]]
            else:
                yield from solve(all_.iloc[:cut], False)
                held = [all_.iloc[cut:]]
            rows = len(held[0])
        if held and sum(map(len, held)):
            yield from solve(pd.concat(held, ignore_index=True), True)

    return run


def _chunk_pairs(radius: int):
    """Pairs of one bucket's chunks whose shared bits differ in ``radius`` or
    fewer: the upper part of the bucket's tree, walked for each chunk."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        ones = p["ones"].to_numpy().view(np.uint64)
        some = p["some"].to_numpy().view(np.uint64)
        chunk = p["chunk"].to_numpy()
        order = np.argsort(gray_rank(ones), kind="stable")
        ones, some, chunk = ones[order], some[order], chunk[order]
        fixed = ~(ones ^ some)
        levels = [(fixed, ones, np.arange(len(ones)), np.zeros(len(ones), np.int64))]
        o, s = ones, some
        while len(o) > 1:
            start = np.arange(0, len(o), FANOUT)
            n = np.diff(np.r_[start, len(o)])
            o, s = shared_bits(o, s, start)
            levels.append((~(o ^ s), o, start, n))
        out = []
        for i in range(len(ones)):
            node = np.zeros(1, np.int64)
            for fx, val, first, n in levels[:0:-1] + levels[:1]:
                node = node[np.bitwise_count((ones[i] ^ val[node]) & fx[node] & fixed[i]) <= radius]
                if n is not levels[0][3]:
                    k = n[node]
                    node = np.repeat(first[node], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            node = node[node > i]
            out.append(pd.DataFrame({"pair_a": np.full(len(node), chunk[i]), "pair_b": chunk[node]}))
        return pd.concat(out, ignore_index=True)

    return run


def _pair_links(radius: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        fp = p["fp"].to_numpy().view(np.uint64)
        side = p["side"].to_numpy()
        order = np.argsort(gray_rank(fp), kind="stable")
        fp, side = fp[order], side[order]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        index = GrayIndex(fp[right], np.zeros(len(right), np.int64))
        found = ((left[q], right[v]) for q, v in
                 index.links(fp[left], np.zeros(len(left), np.int64), radius))
        return _forest_edges(fp, forest(len(fp), found))

    return run


def links(fps: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct
    fingerprints ``fps`` (column fp)."""
    keys = block_keys(radius, block_count(fps.count(), radius, chunk))
    copies = F.array(*[bucket_of(F.col("fp"), i, k) for i, k in enumerate(keys)])
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
        fps = fps.withColumn("gray", rank)
        rank = F.col("gray")
    rows = (fps.select(F.explode(copies).alias("bucket"), "gray", "fp")
            .repartitionByRange(slots(fps.sparkSession), "bucket", "gray")
            .sortWithinPartitions("bucket", "gray"))
    done = stored(rows.mapInPandas(_chunks(radius, chunk), _CHUNKED), "chunks")
    edges = done.where("kind = 0").select(F.col("bucket").alias("a"), F.col("chunk").alias("b"))
    heads = done.where("kind = 1").select("bucket", "chunk", "ones", "some")
    split = heads.groupBy("bucket").count().where("count > 1").select("bucket").hint("shuffle_merge")
    pairs = (heads.join(split, "bucket").groupBy("bucket")
             .applyInPandas(_chunk_pairs(radius), "pair_a long, pair_b long"))
    pairs = stored(pairs, "chunk-pairs")
    members = done.where("kind = 2").select("chunk", "fp")
    sides = [members.join(pairs.hint("shuffle_merge"), F.col("chunk") == F.col(c))
             .select("pair_a", "pair_b", F.lit(i).alias("side"), "fp")
             for i, c in enumerate(("pair_a", "pair_b"))]
    across = (sides[0].union(sides[1]).groupBy("pair_a", "pair_b")
              .applyInPandas(_pair_links(radius), "a long, b long"))
    return edges.union(across)


def _classes(docs: DataFrame, doc_id: str, text: str, shingle: int, radius: int, *more: Column) -> DataFrame:
    """(doc_id, more, fp, root, component_id) per row; root is the group's least fingerprint."""
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                         F.col(f"`{text}`").cast("string").alias("text"), *more)
    fps = stored(add_fingerprint(narrow, "text", "fp", shingle).drop("text"), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fp")
    nodes = components(links(distinct.select("fp"), radius))
    named = distinct.join(nodes.hint("shuffle_merge"), F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = stored(named.join(least.hint("shuffle_merge"), "root").select("fp", "root", "component_id"),
                   "components")
    return fps.join(by_fp.hint("shuffle_merge"), "fp")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           shingle: int = SHINGLE, radius: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``."""
    return _classes(docs, doc_id, text, shingle, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             shingle: int = SHINGLE, radius: int = MAX_BITS) -> DataFrame:
    """One document of each group, with all its columns: a row that carries
    the group's smallest id (one of them, if rows repeat it)."""
    body = F.xxhash64(F.col(f"`{text}`").cast("string"))     # tells rows of one id apart
    best = (_classes(docs, doc_id, text, shingle, radius, body.alias("body"))
            .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min(F.struct("fp", "body")).alias("row"), F.first("component_id").alias("id")))
    mark, key, kbody = fresh(docs, "body"), fresh(docs, "key"), fresh(docs, "key_body")
    best = best.select(F.col("id").alias(key), F.col("row.body").alias(kbody)).hint("shuffle_merge")
    picked = docs.withColumn(mark, body).join(
        best, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(key)) & (F.col(mark) == F.col(kbody)), "left_semi")
    return picked.dropDuplicates([doc_id, mark]).drop(mark)
