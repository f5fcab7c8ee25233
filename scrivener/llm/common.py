"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"     # a word: a run of anything but ASCII white space
WORD_CHARS = 64                 # longest word that is handed to all tasks
ID_BITS = 1 << 26               # of a filter of ids: 8 MB, whatever their number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts lineage (a lost executor never replays what came before) and pins
    the result of anything that must not be evaluated twice."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each step inside are removed when the step ends, so
    that the disk holds those of one step at a time. For steps that store their
    results (``stored``); one that ran again would shuffle again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def near_ids(df: DataFrame, key: str, ids: DataFrame, bits: int = ID_BITS) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids`` (one column), and a few
    more: those that fall on a bit of one. To be put before a shuffle join, which
    then deals out the rows that it keeps, not the texts of all. Ids of different
    types, or of types whose equal values differ in bytes, are not told apart."""
    kind = ids.schema[0].dataType
    if kind != df.schema[key].dataType or not isinstance(kind, (T.LongType, T.IntegerType, T.StringType)):
        return df
    spot, at = (F.pmod(F.xxhash64(F.col(c)), F.lit(bits)) for c in (ids.columns[0], key))
    block, held = fresh(df, "block"), fresh(df, "bits")
    rows = ids.groupBy(F.bitmap_bucket_number(spot).alias(block)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias(held))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return df.withColumn(block, F.bitmap_bucket_number(at)).join(F.broadcast(rows), block).where(
        F.getbit(byte, (place % 8).cast("int")) == 1).select(*df.columns)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names are case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value``, evaluated once per row (an
    expression named twice inside a lambda would run for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def slots(spark: SparkSession) -> int:
    """Reducer count of the session's shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def commonest(counts: DataFrame, limit: int) -> dict[str, int]:
    """The commonest words of ``counts`` (word, n), ``limit`` at most, commonest
    first; words over ``WORD_CHARS`` characters are passed over, so that the
    result is bounded in bytes too. A histogram of the counts (on a log scale,
    some thousand rows) says where to cut, so only the words above the cut leave
    the executors."""
    counts = counts.where(F.length("word") <= WORD_CHARS)
    step = F.floor(F.log2("n") * 64).cast("long")
    tall = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(
        F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    cut, held = None, 0
    for s, k in tall:
        held += k
        if held > limit:
            break
        cut = s
    if cut is None:
        return {}
    rows = counts.where(step >= cut).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist()))
