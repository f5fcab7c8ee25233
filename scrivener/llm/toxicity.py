"""Toxicity through a noisy channel.

Toxic words are often disguised: letters swapped for look-alikes (1d10t),
spread out by any white space or marks (i d i o t, i.d.i.o.t) or drawn out
(idiiot, idiiiot). Each suspicious token becomes a lattice of what every written character may stand for; a
Viterbi search under a character trigram model picks the likeliest reading.
The words of the text, plain and restored, are then scored. A token of plain
letters with a doubled one is decoded only if its letters, each run taken as
one, are those of a marked word: no reading of another could count. A look-alike
beside the very letter it stands for (1i) reads as two letters.

Training, on all labelled documents but the held-out fold (only their texts are
dealt out to meet their labels): words counted once per
document and class give the trigram model and the log-odds of words that mark
toxic documents; a logistic fit of the summed log-odds makes it a probability.
Counting is a Spark aggregate over words of any length, and so are the sums of
each step of the fit. The strongest ``MAX_WORDS`` words and the
commonest ``MAX_GRAMS`` trigrams reach the driver; the trigrams beyond these
count in the shorter contexts that the model backs off to (as many bigrams, and
all single characters).

Edge cases: a null, empty or blank text scores like a text without marked
words. Without labels of both classes every score is the share of toxic labels
(0 if none). Repeated label rows of a document count once, the higher label
winning; null labels are ignored. Repeated documents score alike. Extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import near_ids, stored

MAX_WORDS = 4_096
MAX_GRAMS = 60_000
MIN_DOCS = 4             # documents a marked word is in, at least
MIN_G = 20.0             # G-test value from which a word is marked
MIN_LIFT = 3.0
CACHE_CHARS = 1 << 24    # characters of tokens and readings that a worker remembers
MEMO = 1 << 18           # trigram probabilities it remembers

# What a written character may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
         "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
         "*": "aeiou", "#": "h"}
SEPARATORS = ".-_*~"
EDGES = ".,;:?!\"'()[]{}<>…«»“”‘’"
KEEP, SWAP, DROP, SPACE = math.log(0.97), math.log(0.03), math.log(0.05), math.log(0.02)

_SUSPECT = re.compile(r"[0-9@$!|+€£¡*#._~\-]|(.)\1\1")
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1*", re.S)
_DOUBLED = re.compile(r"([^\W\d_])\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_ENDS = re.compile(r"([$%&*#+|])\1+$")       # marks hung on a word, not letters


class CharModel:
    """Character trigrams with back-off, over words closed by spaces. Keys of one
    or two characters are counts of trigrams that are not listed themselves."""

    def __init__(self, grams: dict[str, float]):
        self.tri, self.bi, self.uni = Counter(), Counter(), Counter()
        for g, n in grams.items():
            if len(g) == 3:
                self.tri[g] += n
                self.bi[g[1:]] += n
                self.uni[g[2]] += n
            else:
                (self.bi if len(g) == 2 else self.uni)[g] += n
        self.tri_ctx, self.bi_ctx = Counter(), Counter()
        for g, n in self.tri.items():
            self.tri_ctx[g[:2]] += n
        for g, n in self.bi.items():
            self.bi_ctx[g[0]] += n
        self.total = sum(self.uni.values())
        self.memo: dict[str, float] = {}

    def logp(self, ctx: str, c: str) -> float:
        g = ctx + c
        got = self.memo.get(g)
        if got is None:
            p = (self.uni[c] + 0.1) / (self.total + 100)
            p = (self.bi[g[1:]] + 2 * p) / (self.bi_ctx[g[1]] + 2)
            p = (self.tri[g] + 2 * p) / (self.tri_ctx[g[:2]] + 2)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[g] = math.log(p)
        return got


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of a character, its readings and their channel log-probability."""
    out = []
    for m in _RUN.finditer(token):
        c, n = m.group(1), len(m.group(0))
        if c == " ":
            out.append([("", DROP / 4), (" ", SPACE)])
            continue
        ways: list[tuple[str, float]] = []
        if _LETTER.match(c):
            ways.append((c, KEEP if n == 1 else math.log(0.003) if n == 2 else math.log(0.5)))
            if n >= 2:
                ways.append((c * 2, KEEP if n == 2 else math.log(0.5)))
        for x in LOOKS.get(c, ""):
            ways.append((x, SWAP - math.log(len(LOOKS[c]))))
            if n >= 2:
                ways.append((x * 2, SWAP - math.log(len(LOOKS[c]))))
        if c in SEPARATORS or not ways:
            ways.append(("", DROP))
        out.append(ways)
    return out


def restore(token: str, model: CharModel) -> str:
    """Likeliest reading of ``token`` (Viterbi; the state is the last two letters)."""
    states: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
    for ways in lattice(token):
        new: dict[str, tuple[float, tuple]] = {}
        for ctx, (lp, path) in states.items():
            for out, cost in ways:
                s, c2 = lp + cost, ctx
                for ch in out:
                    s += model.logp(c2, ch)
                    c2 = c2[1] + ch
                if c2 not in new or s > new[c2][0]:
                    new[c2] = (s, (path, out) if out else path)
        states = new
    best = max(((lp + model.logp(ctx, " "), ctx, path) for ctx, (lp, path) in states.items()),
               key=lambda x: (x[0], x[1]))[2]
    parts = []
    while best:
        best, out = best
        parts.append(out)
    return "".join(reversed(parts))


def squeeze(word: str) -> str:
    """``word`` with each run of one character taken as one."""
    return _RUN.sub(r"\1", word)


def core(token: str) -> str:
    return _ENDS.sub("", token).strip(EDGES)


def plain_words(text: str | None) -> set[str]:
    return {w for w in (core(t) for t in (text or "").lower().split()) if w}


class Scorer:
    def __init__(self, grams: dict[str, float], weights: dict[str, float], slope: float, bias: float):
        self.model, self.weights, self.slope, self.bias = CharModel(grams), weights, slope, bias
        self.squeezed = {squeeze(w) for w in weights}
        self.cache: dict[str, tuple[str, ...]] = {}
        self.held = 0

    def readings(self, token: str) -> tuple[str, ...]:
        got = self.cache.get(token)
        if got is None:
            w = core(token)
            got = (w,) if w else ()
            inner = token.strip(".,;:?\"'()[]{}<>").rstrip("!") if _SUSPECT.search(token) else ""
            inner = _ENDS.sub("", inner)
            if inner and _LETTER.search(inner) and _SUSPECT.search(inner):
                got += tuple(restore(inner, self.model).split())
            elif _DOUBLED.search(w) and squeeze(w) in self.squeezed:
                got += tuple(restore(w, self.model).split())
            size = len(token) + sum(map(len, got))
            if self.held + size > CACHE_CHARS:
                self.cache.clear()
                self.held = 0
            if size <= CACHE_CHARS // 16:
                self.cache[token] = got
                self.held += size
        return got

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        found: set[str] = set()
        for t in set(low.split()):
            found.update(self.readings(t))
        for m in _SPACED.finditer(low):
            got = restore(" ".join(m.group(0).split()), self.model)
            found.update(got.split())
            found.add(got.replace(" ", ""))
        return found

    def raw(self, text: str | None) -> float:
        w = self.weights
        return sum(sorted(w[x] for x in self.words(text) if x in w))

    def score(self, text: str | None) -> float:
        z = self.slope * self.raw(text) + self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled documents to learn from."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                          & (fold(F.col("doc_id"), 5) != 0))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = known.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("long").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text"))
    texts = near_ids(texts, "_doc", known.select("_id"))
    return texts.join(known.hint("merge"), F.col("_doc") == F.col("_id")).select("text", "toxic")


def count_words(train: DataFrame) -> DataFrame:
    """(word, toxic docs, docs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, every = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(every)
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([bad[w] for w in words], pa.int64()),
                 pa.array([every[w] for w in words], pa.int64())], ["word", "bad", "n"])
            bad.clear()
            every.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = plain_words(text)
                every.update(words)
                if toxic:
                    bad.update(words)
                if len(every) > 500_000:
                    yield flush()
        yield flush()

    return (train.mapInArrow(run, "word string, bad long, n long")
            .groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))


def char_grams(words: DataFrame, most: int = MAX_GRAMS) -> dict[str, float]:
    """Trigram counts of (word, n) with two spaces before a word and one after,
    for ``CharModel``: the ``most`` commonest, the others under their last two
    characters (``most`` at most) and their last one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: Counter = Counter()
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                word = f"  {word} "
                for i in range(len(word) - 2):
                    held[word[i:i + 3]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                              pa.array(list(held.values()), pa.int64())], ["g", "n"])

    grams = stored(words.select("word", "n").mapInArrow(run, "g string, n long")
                   .groupBy("g").agg(F.sum("n").alias("n")), "toxic-grams")
    top = grams.orderBy(F.desc("n"), "g").limit(most).collect()
    out = {r["g"]: float(r["n"]) for r in top}
    if len(top) < most:
        return out
    least = top[-1]
    rest = grams.where((F.col("n") < least["n"]) | ((F.col("n") == least["n"]) & (F.col("g") > least["g"])))
    for take, limit in ((2, most), (1, None)):
        tail = rest.groupBy(F.substring("g", 4 - take, take).alias("g")).agg(F.sum("n").alias("n"))
        tail = tail.orderBy(F.desc("n"), "g").limit(limit) if limit else tail
        out.update((r["g"], float(r["n"])) for r in tail.collect())
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple:
    """(trigrams, word weights, slope, bias)."""
    train = stored(training(docs, labels), "toxic-train")
    row = train.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = row["n"], row["bad"] or 0
    if not bad or bad == n:
        share = bad / n if n else 0.0
        return {}, {}, 0.0, -60.0 if share == 0 else 60.0
    words = stored(count_words(train), "toxic-words")
    a, t = F.col("bad").cast("double"), F.col("n").cast("double")
    lift = F.log((a + 0.5) / (bad + 1)) - F.log((t - a + 0.5) / (n - bad + 1))

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    g = 2 * (term(a, t * bad / n) + term(t - a, t * (n - bad) / n)
             + term(bad - a, (n - t) * bad / n) + term(n - bad - t + a, (n - t) * (n - bad) / n))
    marked = words.where(F.col("n") >= MIN_DOCS).select("word", lift.alias("w"), g.alias("g")).where(
        (F.col("g") >= MIN_G) & (F.col("w") >= math.log(MIN_LIFT))).orderBy(F.desc("g"), "word").limit(MAX_WORDS)
    weights = {r["word"]: r["w"] for r in marked.collect()}
    grams = char_grams(words)
    raw = Scorer(grams, weights, 1.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([raw.raw(x) for x in b.column(0).to_pylist()], pa.float64()), b.column(1)], ["x", "y"])

    rows = stored(train.mapInArrow(run, "x double, y long").groupBy("x", "y").agg(F.count(F.lit(1)).alias("k")), "toxic-logits")
    slope, bias = logistic(rows, n, bad)
    return grams, weights, slope, bias


def logistic(rows: DataFrame, n: int, bad: int) -> tuple[float, float]:
    """One-feature logistic fit (Newton) of (x, y, times), with smoothed targets.
    Each step is one aggregate; only its sums reach the driver."""
    x, k = F.col("x"), F.col("k")
    y = F.when(F.col("y") > 0, (bad + 1) / (bad + 2)).otherwise(1 / (n - bad + 2))
    w = np.zeros(2)
    for _ in range(50):
        z = x * float(w[0]) + float(w[1])
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        h, r = k * F.greatest(p * (1 - p), F.lit(1e-9)), k * (y - p)
        s = rows.select(x, h.alias("h"), r.alias("r")).agg(
            *[F.sum(c).alias(name) for name, c in (("hxx", F.col("h") * x * x), ("hx", F.col("h") * x), ("h", F.col("h")),
                                                   ("rx", F.col("r") * x), ("r", F.col("r")))]).first()
        curve = np.array([[s["hxx"], s["hx"]], [s["hx"], s["h"]]]) + np.eye(2) * 1e-2
        step = np.linalg.solve(curve, np.array([s["rx"], s["r"]]) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: tuple, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every document, whole texts."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                      F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([scorer.score(x) for x in b.column(1).to_pylist()], pa.float64())],
                ["doc_id", "score"])

    return src.mapInArrow(run, "doc_id long, score double")
