"""Language-model scoring with a gated recurrent model.

Tokens are lower-cased words and one end mark per text. The words of all
training texts are counted (a Spark aggregate). The commonest ``LISTED`` words
have ids in the recurrent model (gru.py); for any other word the model gives
the probability of "off the list", times the word's add-one share among those
words. State is carried over the whole text, however long.

Texts are tokenised twice, some MB at a time: to count, and then to be written as numbers of their
words, which training and scoring read. Training is distributed: the training documents are dealt over ``ROUNDS`` rounds
by a hash of the id and the text, each to one round. In a round every partition
trains a copy of the model on its documents of that round, and the copies are
averaged by their number of tokens.

Words and documents meet without a corpus-sized broadcast: the ``COMMON``
commonest words (a fixed number, of bounded length) are looked up in the task, so
no hot word is ever shuffled per document; the rest is an equi-join of (word,
document, times).

Edge cases: a null or empty text is its end mark alone. Repeated documents are
counted and scored each; a null doc_id is an id of its own (the empty text for
the fold). With no training text at all every probability is 1 (log 0). An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm import gru
from scrivener.llm.common import commonest, stored

END = ""                 # no word is empty
COMMON = 65_535          # words looked up without a shuffle, at most (numbers of 16 bits, one for all others)
LISTED = 4_095           # words with an id in the model
ROUNDS = 3
BUFFER = 2_000_000       # tokens that are trained on at a time
FOLDS, HELD_OUT = 7, 2
PIECE = 1 << 22          # bytes of text whose words are looked up together


def pieces(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``PIECE`` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(size // PIECE)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row, ASCII letters lower-cased, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)       # not those before and after white space at the ends
    of = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    return words.filter(real), np.bincount(of[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all texts (first column)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, 0):
                c = pc.value_counts(words_of(piece.column(0))[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([c.field(0), pa.array([END], c.field(0).type)]),
                     pa.concat_arrays([c.field(1), pa.array([piece.num_rows])])], ["word", "n"])

    return train.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_DOC = ("row long, doc_id long, held_out boolean, round int, ids binary, known long, logs double, "
        "words array<string>, times array<int>")


def numbered(src: DataFrame, common: dict[str, int]) -> DataFrame:
    """Each text as ids, once for all that follows: the place of each token in
    ``common`` (commonest first; len(common) for other words). With the base sums
    over common words, and the other words with their times."""
    ids = pa.array(common, pa.string())
    logs = np.append(np.log10(np.array(list(common.values()), dtype=np.float64) + 1), 0.0)
    rest = len(common)
    end = list(common).index(END) if END in common else rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 33
        for b in (piece for whole in batches for piece in pieces(whole, 1)):
            words, sizes = words_of(b.column(1))
            words = words.dictionary_encode()
            listed, code = words.dictionary, words.indices.to_numpy()
            place = pc.fill_null(pc.index_in(listed, ids.cast(listed.type)), rest).to_numpy().astype("<u2")[code]
            edges = np.r_[0, np.cumsum(sizes + 1)]
            seq = np.full(edges[-1], end, "<u2")
            own = np.ones(len(seq), bool)
            own[edges[1:] - 1] = False           # the end marks
            seq[own] = place
            # each other word of each text with its times
            other = place == rest
            of = np.repeat(np.arange(len(sizes)), sizes)[other]
            rare, times = np.unique(of * len(listed) + code[other], return_counts=True)
            of, rare = np.divmod(rare, max(1, len(listed)))
            lists = pa.array(np.searchsorted(of, np.arange(len(sizes) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + b.num_rows, dtype=np.int64)), b.column(0), b.column(2), b.column(3),
                 pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((2 * edges).astype(np.int32)),
                                                                 pa.py_buffer(seq)]),
                 pa.array(np.add.reduceat(seq < rest, edges[:-1], dtype=np.int64)),
                 pa.array([float(logs[seq[x:y]].sum()) for x, y in zip(edges.tolist(), edges[1:].tolist())], pa.float64()),
                 pa.ListArray.from_arrays(lists, listed.take(pa.array(rare))),
                 pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))],
                ["row", "doc_id", "held_out", "round", "ids", "known", "logs", "words", "times"])
            at += b.num_rows

    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit("round")), F.lit(ROUNDS)).cast("int")
    return src.select("doc_id", "text", held_out(F.col("doc_id")).alias("h"), turn.alias("r")).mapInArrow(run, _DOC)


def sequences(column: pa.Array, off: int) -> list[np.ndarray]:
    """The texts of a batch as ids of the model: all from ``off`` on are one."""
    return [np.minimum(np.frombuffer(x, "<u2"), off).astype(np.int64) for x in column.to_pylist()]


def train_model(texts: DataFrame, off: int, start: int, params: dict) -> dict:
    """Rounds of local training and averaging over all of ``texts`` (round, ids)."""
    for r in range(ROUNDS):
        flat = gru.flatten(params)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = gru.unflatten(flat, params)
            held, size, n = [], 0, 0
            for b in batches:
                for seq in sequences(b.column(0), off):
                    held.append(seq)
                    size += len(seq)
                    if size > BUFFER:                # a bounded buffer, then on with the same copy
                        n += gru.train(p, held, start)
                        held, size = [], 0
            if held:
                n += gru.train(p, held, start)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat), dtype=np.int32)),
                     pa.array((gru.flatten(p) * float(n)).astype(np.float64)),
                     pa.array(np.full(len(flat), float(n)))], ["i", "wv", "w"])

        # as many rows as the model has parameters, whatever the corpus
        got = (texts.where(F.col("round") == r).select("ids").mapInArrow(run, "i int, wv double, w double")
               .groupBy("i").agg((F.sum("wv") / F.sum("w")).alias("v")).orderBy("i").toArrow())
        if got.num_rows:
            params = gru.unflatten(got.column("v").to_numpy(), params)
    return params


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10)."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                      F.col(f"`{text}`").cast("string").alias("text"))
    train = src.where(~held_out(F.col("doc_id")))
    counts = stored(word_counts(train.select("text")), "word-counts")
    row = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = row["n"] or 0, row["v"]
    common = commonest(counts, COMMON)
    off = min(LISTED, len(common))
    listed = np.array(list(common.values())[:off], dtype=np.float64)
    rest = total - listed.sum()
    start = next((i for i, w in enumerate(common) if w == END and i < off), off)
    texts = stored(numbered(src, common), "numbered")
    params = train_model(texts.where("not held_out"), off, start, gru.initial(np.r_[listed, rest]))
    log_listed = np.append(np.log10(listed + 1), 0.0)

    kept = ["row", "doc_id", "held_out", "known", "logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = sequences(b.column(len(kept)), off)
            model = gru.log_likelihood(params, seqs, start) / math.log(10)
            # what listed words add to the base is not part of the model's off-list share
            in_list = np.array([log_listed[q].sum() for q in seqs])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([len(q) for q in seqs], pa.int64()),
                 pa.array([int((q == off).sum()) for q in seqs], pa.int64()), pa.array(model - in_list, pa.float64())],
                [*kept, "n_tokens", "off", "model"])

    made = texts.select(*kept, "ids").mapInArrow(
        run, "row long, doc_id long, held_out boolean, known long, logs double, n_tokens long, off long, model double")
    rare = (texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x"))
            .select("row", F.col("x.words").alias("word"), F.col("x.times").alias("t")))
    found = (rare.join(counts.hint("shuffle_merge"), "word", "left")
             .groupBy("row").agg(
                 F.sum(F.col("t") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_logs"),
                 F.sum(F.when(F.col("n") > 0, F.col("t")).otherwise(0)).alias("rare_known")))
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    spread = math.log10(rest + (kinds - off) + 1)        # the off-list words, one unseen kind included
    return (made.join(found.hint("shuffle_merge"), "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"),
        (F.col("model") + logs - F.col("off") * spread).alias("score")))
