"""Trie of shared conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of first d turns; the root (d = 0) is the empty
sequence. A prefix is known by 128 bits: two independent hashes of each turn and
its place, combined by exclusive or, so a prefix digest is a running aggregate
and the digest one turn shorter is known without a second row.

All prefix digests are counted in a count-min sketch: ``ROWS`` rows of cells,
each cell remembering "once" or "more". It never counts too low, so a digest that
meets "once" in any row belongs to one conversation alone. Such a prefix and all
that follows it is a chain of its own, whose nodes are emitted where their rows
are. Only the other prefixes are shuffled and grouped by digest, which is exact:
a digest that the sketch let through by chance makes a group of one. The sketch
has 8 cells a prefix and row, at most ``MAX_CELLS``: 32 MB for all rows is the
most that is sent to tasks. Beyond some 10 million prefixes more of them are
grouped; the result stays the same.

Subtree sums need no walk over levels. A node is represented by its smallest
member. For each conversation, what the nodes it represents add up to from depth
d on is a running sum from its end; the subtree sum of a node is the sum of that
over its members.

Edge cases: a null role or text is empty; rows without a conversation id are left
out. Turns are ordered by turn (null first), then role, text length and text
hash; repeated rows are turns of their own. Conversations that end at the same
node, also the empty one, are all its members. An empty table gives an empty
result (not even a root). A conversation of any length is numbered and digested
in slices. Of the table only conv_id, turn, role and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import slots, stored
from scrivener.operators.base import row_number_asc

ROWS = 4                    # rows of the sketch
MAX_CELLS = 1 << 26         # cells of a row
BUILDERS = 256              # most tasks that build a sketch
PIECE = 1 << 16             # bytes of a row that are merged together
SLICE = 256                 # turns that are numbered or digested together
ENDS = 4096                 # conversation ids that are joined at a time
FIRST = -(1 << 63)
KEY = ["depth", "x1", "x2"]


class Trie(NamedTuple):
    """``nodes``: depth, x1, x2 (digest), conv_id, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, src and no (where the last turn's text
    is), alone, last (does its conversation end here; alone nodes only).
    ``ends``: depth, x1, x2, conv_id of conversations ending at nodes that are
    not alone."""
    nodes: DataFrame
    ends: DataFrame


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, no, role, text) with turns numbered from 1."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return _number(rows.withColumn("chars", F.char_length("text")).withColumn("t1", F.xxhash64("role", "text"))
                   ).select("conv_id", "no", "role", "text")


def _number(rows: DataFrame) -> DataFrame:
    place = F.coalesce(F.floor(F.col("turn") / SLICE).cast("long"), F.lit(FIRST))
    return row_number_asc(rows, ["conv_id"], ["turn", "role", "chars", "t1"], place, "no")


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, no, t1, t2, chars): two hashes of each turn, its texts left behind."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("second"), text, role).alias("t2"), F.char_length(text).alias("chars"))
    return _number(rows).select("conv_id", "no", "t1", "t2", "chars")


class Sequences(NamedTuple):
    """``turns``: conv_id, depth (from 1), src, no, t1, t2, chars; ``sizes``: conv_id, n."""
    turns: DataFrame
    sizes: DataFrame


def as_written(conversations: DataFrame) -> Sequences:
    """Conversations as they are."""
    t = stored(digests(conversations), "trie-turns")
    return Sequences(t.select("conv_id", F.col("no").alias("depth"), F.col("conv_id").alias("src"), "no",
                              "t1", "t2", "chars"),
                     t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> Sequences:
    """Each conversation c with its first h turns replaced by those of
    conversation c - c % ``every``; h is crc32(decimal c) % ``most``."""
    t = stored(digests(conversations), "trie-turns")
    c = F.col("conv_id")
    own = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    theirs = own.select(c.alias("base"), F.col("n").alias("n_base"))
    sizes = stored(own.join(theirs, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("k"), "n"), "trie-sizes")
    first = t.where(F.col("no") < most).withColumnRenamed("conv_id", "base")
    head = sizes.where("k > 0").join(first, "base").where("no <= k").select(
        "conv_id", F.col("no").alias("depth"), F.col("base").alias("src"), "no", "t1", "t2", "chars")
    rest = t.join(sizes.drop("n"), "conv_id").where("no > h").select(
        "conv_id", (F.col("k") + F.col("no") - F.col("h")).alias("depth"), F.col("conv_id").alias("src"), "no",
        "t1", "t2", "chars")
    return Sequences(head.union(rest), sizes.select(
        "conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))


def prefixes(seq: Sequences) -> DataFrame:
    """One row per conversation and depth >= 1: conv_id, n, depth, chars, src,
    no, digest x1, x2 and the digest one turn shorter, p1, p2."""
    t = seq.turns.select("conv_id", "depth", "src", "no", "chars", F.xxhash64("depth", "t1", "t2").alias("g1"),
                         F.xxhash64("t2", "t1", "depth", F.lit("second")).alias("g2"),
                         F.floor(F.col("depth") / SLICE).alias("slice"))
    totals = t.groupBy("conv_id", "slice").agg(F.bit_xor("g1").alias("s1"), F.bit_xor("g2").alias("s2"))
    older = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "slice", *[F.coalesce(F.bit_xor(s).over(older), F.lit(0)).alias(s)
                                                 for s in ("s1", "s2")])
    within = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = t.withColumn("r1", F.bit_xor("g1").over(within)).withColumn("r2", F.bit_xor("g2").over(within))
    x1, x2 = F.col("r1").bitwiseXOR(F.col("s1")), F.col("r2").bitwiseXOR(F.col("s2"))
    return run.join(before, ["conv_id", "slice"]).join(seq.sizes, "conv_id").select(
        "conv_id", F.col("n").cast("long").alias("n"), F.col("depth").cast("long").alias("depth"),
        F.col("chars").cast("long").alias("chars"), "src", F.col("no").cast("long").alias("no"),
        x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("g1")).alias("p1"), x2.bitwiseXOR(F.col("g2")).alias("p2"))


# ------------------------------------------------------------------ the sketch

def cells_of(x1: np.ndarray, x2: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each digest in each row of the sketch."""
    mask = np.uint64(cells - 1)
    halves = [x1, x1 >> np.uint64(32), x2, x2 >> np.uint64(32)][:ROWS]
    return [(h & mask).astype(np.int64) for h in halves]


def count_in(once: np.ndarray, more: np.ndarray, cell: np.ndarray) -> None:
    """Counts ``cell`` into the bit maps of one row."""
    c, n = np.unique(cell, return_counts=True)
    byte, bit = c >> 3, (1 << (c & 7)).astype(np.uint8)
    again = (n > 1) | ((once[byte] & bit) > 0)
    np.bitwise_or.at(more, byte[again], bit[again])
    np.bitwise_or.at(once, byte, bit)


def shared_in(more: np.ndarray, x1: np.ndarray, x2: np.ndarray, cells: int) -> np.ndarray:
    """Is the estimate of each digest above one?"""
    out = np.ones(len(x1), bool)
    for row, cell in zip(more, cells_of(x1, x2, cells)):
        out &= (row[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).view(np.uint64)


def sketch(digest: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bit maps (``ROWS`` x cells / 8) of the cells that hold more than one of
    the ``n`` digests (x1, x2), and the number of cells."""
    cells = min(MAX_CELLS, max(1024, 1 << max(8 * n - 1, 1).bit_length()))
    piece = min(PIECE, cells // 8)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros((2, ROWS, cells // 8), np.uint8)
        some = False
        for b in batches:
            for r, cell in enumerate(cells_of(_unsigned(b, "x1"), _unsigned(b, "x2"), cells)):
                count_in(once[r], more[r], cell)
            some = some or b.num_rows > 0
        for r in range(ROWS if some else 0):
            for at in range(0, cells // 8, piece):
                if once[r, at:at + piece].any():
                    yield pa.RecordBatch.from_pydict({
                        "r": pa.array([r], pa.int32()), "at": pa.array([at], pa.int64()),
                        "once": [once[r, at:at + piece].tobytes()], "more": [more[r, at:at + piece].tobytes()]})

    def merge(parts: pa.Table) -> pa.Table:
        once, more = np.zeros((2, piece), np.uint8)
        for o, m in zip(parts.column("once").to_pylist(), parts.column("more").to_pylist()):
            o, m = np.frombuffer(o, np.uint8), np.frombuffer(m, np.uint8)
            more |= m | (once & o)
            once |= o
        return pa.table({"r": parts.column("r")[:1], "at": parts.column("at")[:1], "more": [more.tobytes()]})

    pieces = (digest.select("x1", "x2").coalesce(BUILDERS)
              .mapInArrow(build, "r int, at long, once binary, more binary")
              .groupBy("r", "at").applyInArrow(merge, "r int, at long, more binary").collect())
    out = np.zeros((ROWS, cells // 8), np.uint8)
    for p in pieces:
        out[p["r"], p["at"]:p["at"] + piece] = np.frombuffer(p["more"], np.uint8)
    return out, cells


def screened(rows: DataFrame) -> DataFrame:
    """``rows`` (from ``prefixes``) with ``shared`` and ``p_shared``: may the
    prefix, or the one a turn shorter, belong to several conversations?"""
    more, cells = sketch(rows, rows.count())
    sent = rows.sparkSession.sparkContext.broadcast(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = shared_in(sent.value, _unsigned(b, "x1"), _unsigned(b, "x2"), cells)
            above = shared_in(sent.value, _unsigned(b, "p1"), _unsigned(b, "p2"), cells)
            above |= b.column(b.schema.get_field_index("depth")).to_numpy() == 1     # the root is all's
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mine), pa.array(above)],
                                             [*b.schema.names, "shared", "p_shared"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, shared boolean, p_shared boolean")


# -------------------------------------------------------------------- the trie

def trie(seq: Sequences) -> Trie:
    rows = stored(screened(stored(prefixes(seq), "trie-prefixes")), "trie-screened")
    none = F.lit(None).cast("long")
    least = seq.sizes.agg(F.min("conv_id")).first()[0]
    # prefixes to be grouped, and the root's row of every conversation
    root = seq.sizes.select("conv_id", F.col("n").cast("long").alias("n"), *[F.lit(0).cast("long").alias(c) for c in (
        "depth", "chars")], none.alias("src"), none.alias("no"), *[F.lit(0).cast("long").alias(c) for c in (
            "x1", "x2", "p1", "p2")], F.lit(True).alias("shared"), F.lit(False).alias("p_shared"))
    many = rows.where("shared").unionByName(root)
    alone = rows.where("not shared")

    groups = many.groupBy(*KEY).agg(
        F.min(F.struct("conv_id", "src", "no")).alias("m"), F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.max("p_shared").alias("p_shared"))
    groups = stored(groups.select(*KEY, "m.*", "n_convs", "chars", "p1", "p2", "p_shared"), "trie-groups")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    kids = (groups.where("p_shared").select(*up).unionByName(alone.where("p_shared").select(*up))
            .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children")))
    groups = stored(groups.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))),
                    "trie-children")

    # sums over what a conversation represents, from each depth on
    gives = groups.select("conv_id", "depth", none.alias("x1"), none.alias("x2"),
                          (F.col("n_children") == 0).cast("long").alias("leaf"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.lit(False).alias("asks"))
    tails = alone.where("depth = n").select("conv_id", "depth", none.alias("x1"), none.alias("x2"),
                                            F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"),
                                            F.lit(False).alias("asks"))
    asks = many.select("conv_id", "depth", "x1", "x2", F.lit(0).cast("long").alias("leaf"),
                       F.lit(0).cast("long").alias("saved"), F.lit(True).alias("asks"))
    onward = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    sums = (gives.unionByName(tails).unionByName(asks)
            .select(*KEY, "asks", F.sum("leaf").over(onward).alias("leaf"), F.sum("saved").over(onward).alias("saved"))
            .where("asks").groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))

    above = groups.select(*KEY, F.col("conv_id").alias("above"))

    def with_parent(df: DataFrame) -> DataFrame:
        """parent_conv_id, from the group one turn up where that is not the root."""
        deep = df.where("p_shared and depth > 1").withColumn("depth", F.col("depth") - 1)
        found = (deep.join(above.withColumnsRenamed({"x1": "p1", "x2": "p2"}), ["depth", "p1", "p2"])
                 .withColumn("depth", F.col("depth") + 1).withColumnRenamed("above", "parent_conv_id"))
        rest = df.where("not p_shared or depth <= 1").withColumn(
            "parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).when(F.col("depth") > 1, F.col("conv_id")))
        return found.unionByName(rest)

    nodes = with_parent(groups).join(sums, KEY)
    single = with_parent(alone.select(
        *KEY, "conv_id", "src", "no", "p1", "p2", "p_shared", F.lit(1).cast("long").alias("n_convs"),
        (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), (F.col("depth") == F.col("n")).alias("last")))
    out = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "src", "no"]
    both = nodes.select(*out, F.lit(False).alias("alone"), F.lit(False).alias("last")).unionByName(
        single.select(*out, F.lit(True).alias("alone"), "last"))
    return Trie(both, many.where("depth = n").select(*KEY, "conv_id"))


def last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with role and text of their last turn (null for the root)."""
    texts = numbered(conversations).withColumnRenamed("conv_id", "src")
    return nodes.join(texts, ["src", "no"], "left")


def ends_digest(t: Trie) -> DataFrame:
    """Nodes with ``ends_sha256``: SHA-256 of the decimal ids of the
    conversations that end there, ascending, comma-joined. Ids are joined in
    ranges of ``ENDS``; the ranges of a node are hashed one after the other."""
    some = (t.ends.groupBy(*KEY, F.floor(F.col("conv_id") / ENDS).alias("range"))
            .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
            .select(*KEY, "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], pa.int64()) for v in now], pa.array([state.hexdigest()])], [*KEY, "sha"])

        for b in batches:
            for *key, ids in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in (*KEY, "ids")]):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        yield done()
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
        if now is not None:
            yield done()

    shas = (some.repartition(slots(some.sparkSession), *KEY).sortWithinPartitions(*KEY, "range")
            .mapInArrow(run, "depth long, x1 long, x2 long, sha string"))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    mine: Column = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nobody)
    grouped = t.nodes.where("not alone").join(shas, KEY, "left").withColumn("ends_sha256", F.coalesce("sha", nobody))
    return grouped.drop("sha").unionByName(t.nodes.where("alone").withColumn("ends_sha256", mine))
