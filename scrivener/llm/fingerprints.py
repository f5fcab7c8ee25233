"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (ASCII letters lower-cased), weighted by how
often they occur. For each of ``SAMPLES`` draws every term gets, from a hash of
the term and the draw's number alone, r and c from Gamma(2, 1) and b from
Uniform(0, 1). With weight s, t = floor(ln s / r + b) and y = exp(r * (t - b));
the draw takes the term with the least c / (y * exp(r)) and remembers (term, t).
Two texts agree on a draw with a probability equal to their generalised Jaccard
similarity: sum of the lesser weights over sum of the greater ones (Ioffe 2010).
A fingerprint is 16 bits of a hash of (term, t) for each draw, in hexadecimal.

The least value is found on integers (31 bits of ln(c / (y * exp(r))), then the
hash), so a last-digit difference of another machine's logarithm cannot turn
into another fingerprint unless two terms tie that closely.

``edited`` compares each text with its successor in ascending id. Rows are dealt
out by id range, with the first row of each range copied to the range before it,
so every row meets its successor in a sorted, streamed partition: texts are
shuffled once and no group is held.

Edge cases: a null text is empty; a text without words has the fingerprint of
zeros, alike (1) only to other such texts. Null ids come first. Rows of one id
follow each other in the order of a hash of their text, repeated rows each get a
row. The last row is followed by the first, a single row by itself. Any text
length is processed whole. An empty table gives an empty result. Of the table
only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.llm.common import fresh, slots

SAMPLES = 128
ROOM = 1 << 18            # (term, weight) pairs whose draws a Python worker remembers (256 MB)
GROUP = 1 << 21           # bytes of text whose words are looked up together
SLICE = 8192              # draws that are made at a time
NOTHING = np.iinfo(np.int64).max
FIRST = -(1 << 63)        # stands for a null id

_U = np.uint64


def mixed(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """Finaliser of splitmix64. With ``spare``, an array alike, ``x`` itself is changed."""
    if spare is None:
        x, spare = x.copy(), np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, _U(shift), out=spare)
        x ^= spare
        x *= _U(factor)
    np.right_shift(x, _U(31), out=spare)
    x ^= spare
    return x


def odd(x: np.ndarray, at: int, out: np.ndarray) -> np.ndarray:
    """21 of the 64 bits, doubled and one more: 2**22 times a number strictly
    between 0 and 1."""
    if at:
        np.right_shift(x, _U(21 * at - 1), out=out)
    else:
        np.left_shift(x, _U(1), out=out)
    out |= _U(1)
    out &= _U((1 << 22) - 1)
    return out


def log_of_two(x: np.ndarray, spare: tuple[np.ndarray, np.ndarray], out: np.ndarray) -> np.ndarray:
    """Logarithm of the product of the first two numbers of ``x``; the product is exact."""
    product = odd(x, 0, spare[0])
    product *= odd(x, 1, spare[1])
    np.multiply(product.view(np.int64), 2.0 ** -44, out=out)
    return np.log(out, out=out)


def draws(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES, out: np.ndarray | None = None) -> np.ndarray:
    """One integer per (term hash, draw): the value to be least in the upper
    bits, the hash of (term, t) in the lower 32. Some terms at a time and in
    place, so that all arrays stay in a core's cache."""
    if out is None:
        out = np.empty((len(terms), samples), np.int64)
    some = max(1, min(len(terms), SLICE // samples))
    room = [np.empty((some, samples), np.uint64) for _ in range(4)]
    floats = [np.empty((some, samples)) for _ in range(3)]
    with np.errstate(over="ignore"):
        each = mixed(np.arange(1, samples + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        for at in range(0, len(terms), some):
            n = min(some, len(terms) - at)
            one, two, a, b = (x[:n] for x in room)
            log_r, value, share = (x[:n] for x in floats)
            mixed(np.bitwise_xor(terms[at:at + n, None], each, out=one), a)
            mixed(np.add(one, _U(0x9E3779B97F4A7C15), out=two), a)
            log_r = log_of_two(one, (a, b), log_r)               # r is its negative
            log_of_two(two, (a, b), value)
            np.negative(value, out=value)
            np.log(value, out=value)                             # ln c
            np.multiply(odd(one, 2, a).view(np.int64), 2.0 ** -22, out=share)
            often = np.flatnonzero(weights[at:at + n] > 1)
            if len(often):
                r = -log_r[often]
                t = np.floor(np.log(weights[at + often])[:, None] / r + share[often])
                two[often] ^= t.astype(np.int64).view(np.uint64) * _U(0xD6E8FEB86659FD93)
            np.subtract(1.0, share, out=share)
            share *= log_r
            value += share                                       # t = 0, as for all terms that occur once
            if len(often):
                value[often] -= r * t
            value += 128.0
            value *= 1 << 23
            place = a.view(np.int64)
            np.copyto(place, value, casting="unsafe")
            place <<= 32
            mixed(two, b)
            two >>= _U(32)
            np.bitwise_or(place, two.view(np.int64), out=out[at:at + n])
    return out


class Sampler:
    """Fingerprints of texts, remembering the draws of recent terms: a half of the
    table is filled, then the other; what is met again is taken over from the half
    before, so frequent terms stay."""

    def __init__(self, samples: int = SAMPLES, room: int = ROOM):
        self.samples, self.half = samples, room // 2
        self.place: dict = {}
        self.before: dict = {}
        self.start = 0
        self.table = np.empty((2 * self.half, samples), np.int64)

    def _rows(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Table rows of at most ``half`` different terms with their weights."""
        if len(self.place) + len(hashes) > self.half:
            self.before, self.place, self.start = self.place, {}, self.half - self.start
        place = self.place
        items = list(zip(hashes.tolist(), weights.tolist()))
        got = np.array([place.get(x, -1) for x in items], np.int64)
        lacking = np.flatnonzero(got < 0)
        if len(lacking):
            old = np.array([self.before.get(items[k], -1) for k in lacking.tolist()], np.int64)
            known, new = lacking[old >= 0], lacking[old < 0]
            at = self.start + len(place)
            end = at + len(known)
            self.table[at:end] = self.table[old[old >= 0]]
            draws(hashes[new], weights[new], self.samples, self.table[end:end + len(new)])
            lacking = np.concatenate([known, new])
            got[lacking] = np.arange(at, at + len(lacking))
            place.update(zip([items[k] for k in lacking.tolist()], range(at, at + len(lacking))))
        return got

    def _some(self, texts: list[bytes]) -> np.ndarray:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        found = split.flatten().dictionary_encode()
        listed = found.dictionary.view(pa.binary()).to_pylist()
        of = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
        at = of * len(listed) + found.indices.to_numpy()
        if b"" in listed:                    # before and after white space at the ends
            at = at[at % len(listed) != listed.index(b"")]
        # each word of each text with its count, in the order of the texts
        at, n = np.unique(at, return_counts=True)
        of, word = np.divmod(at, max(1, len(listed)))
        word, back = np.unique(word * (n.max(initial=0) + 1) + n, return_inverse=True)
        word, weight = np.divmod(word, n.max(initial=0) + 1)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in listed], np.uint64)[word]
        edges = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
        least = np.full((len(texts), self.samples), NOTHING)
        for lo in range(0, len(word), self.half):
            rows = self._rows(hashes[lo:lo + self.half], weight[lo:lo + self.half].astype(np.float64))
            for i, (x, y) in enumerate(zip(edges, edges[1:])):
                mine = back[x:y]
                if len(word) > self.half:
                    mine = mine[(mine >= lo) & (mine < lo + self.half)] - lo
                if len(mine):
                    np.minimum(least[i], self.table.take(rows[mine], axis=0).min(axis=0), out=least[i])
        return np.where(least == NOTHING, 0, least & 0xFFFF).astype(np.uint16)

    def sign_all(self, texts: list[str]) -> np.ndarray:
        """A row of ``samples`` numbers of 16 bits for each text."""
        made, some, size = [], [], 0
        for t in texts:
            some.append(t.encode("utf-8", "surrogatepass").lower())
            size += len(some[-1])
            if size > GROUP:
                made.append(self._some(some))
                some, size = [], 0
        if some:
            made.append(self._some(some))
        return np.concatenate(made) if made else np.empty((0, self.samples), np.uint16)

    def sign(self, text: str) -> np.ndarray:
        return self.sign_all([text])[0]


@functools.cache
def sampler(samples: int) -> Sampler:
    """One for all tasks of a Python worker, with the draws that it remembers."""
    return Sampler(samples)


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of draws on which two fingerprints agree."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda n, k: n + F.when(
        F.substring(a, 4 * k + 1, F.lit(4)) == F.substring(b, 4 * k + 1, F.lit(4)), 1).otherwise(0)) / samples


def fingerprint(docs: DataFrame, text: str = "text", out: str | None = None, samples: int = SAMPLES) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in a column ``out`` (a name
    that is free, if none is given). No shuffle."""
    name = out or fresh(docs, "fingerprint")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(map(hexed, sampler(samples).sign_all([t or "" for t in b.column(where).to_pylist()])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def with_successor(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(range, copy, key, text) dealt out and sorted so that each row with copy
    0 is followed, in its partition, by its successor in ascending key."""
    spark = docs.sparkSession
    parts = slots(spark)
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(FIRST)).alias("k"),
                       F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    cuts = np.unique(np.array(rows.select("k").approxQuantile(
        "k", [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else [], np.float64))

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(dtype=np.float64), side="right").astype(np.int32))

    heads = sorted((r["r"], r["k"]) for r in rows.groupBy(range_of("k").alias("r")).agg(F.min("k").alias("k")).collect())
    # the first row of a range also follows the range before; the very first, the last one
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def goes_to(k: pd.Series) -> pd.Series:
        mine = np.searchsorted(cuts, k.to_numpy(dtype=np.float64), side="right").tolist()
        return pd.Series([[m, before[v]] if v in before else [m] for m, v in zip(mine, k.tolist())], dtype=object)

    dealt = rows.select(F.posexplode(goes_to("k")).alias("copy", "range"), "k", "id", "t")
    return (dealt.repartitionById(parts, F.col("range"))
            .sortWithinPartitions("range", "copy", "k", F.xxhash64("t")))


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL(
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.empty((1, samples), np.uint16)        # that of the held row, in front of those to be made
        held = None                                      # the row whose successor comes next, and its place
        todo, pairs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            signs = np.concatenate([first, sampler(samples).sign_all(todo)])
            out = [(hid, len(ht), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                    hexed(signs[h]), hexed(signs[e]), float((signs[h] == signs[e]).mean()),
                    float((signs[h] == signs[x]).mean())) for hid, ht, changed, h, e, x in pairs]
            if held is not None:
                first[0] = signs[held[2]]
            todo.clear()
            pairs.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for b in batches:
            for copy, ident, t in zip(*[b.column(c).to_pylist() for c in ("copy", "id", "t")]):
                if copy and held is None:
                    continue
                todo.append(t)
                own = len(todo)
                if held is not None:
                    hid, ht, hs = held
                    todo.append(edit(ht, t))
                    pairs.append((hid, ht, todo[-1], hs, own + 1, own))
                    size += len(todo[-1])
                size += len(t)
                held = None if copy else (ident, t, own)
                if size > GROUP:
                    yield flush()
                    held, size = held and (ident, t, 0), 0
        if todo:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return with_successor(docs, key, text).select("range", "copy", "id", "t").mapInArrow(run, schema)
