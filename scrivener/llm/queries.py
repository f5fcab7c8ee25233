"""The registered queries of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm import (decontaminate, fingerprints, kneser_ney, lm_scoring, mixing, pii, preferences, prefix_trie,
                           quality_rules, sharding, simhash, toxicity, whitening)
from scrivener.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("op1_mixing")
def op1(spark, sf_dir):
    """Entropy-balanced mix of all documents."""
    p = mixing.plan(documents(spark, sf_dir), keep=("doc_id", "source"))
    return p.select("doc_id", "source", "size", "source_size", "target", "rate", "copies",
                    (F.col("copies") * F.col("size")).alias("taken"))


@query("op3_quality_rules")
def op3(spark, sf_dir):
    """Counts of every document and the verdict of the voting rules."""
    return quality_rules.report(documents(spark, sf_dir))


@query("op4_sharding")
def op4(spark, sf_dir):
    """All documents in 16 shards of near equal row counts (law: rows)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                                       "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_simhash")
def op5(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    return simhash.groups(documents(spark, sf_dir))


@query("op6_decontamination")
def op6(spark, sf_dir):
    """Contaminated documents and the benchmark items found in them."""
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op10_pii")
def op10(spark, sf_dir):
    """Personal data spans of every document."""
    return pii.find(documents(spark, sf_dir))


@query("op7_toxicity")
def op7(spark, sf_dir):
    """Toxicity of every document; fold 0 of 5 is held out from learning."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_lm_scoring")
def op9(spark, sf_dir):
    """Log-probability of every document; fold 2 of 7 is held out from learning."""
    return lm_scoring.score(documents(spark, sf_dir))


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    """Perplexity of every document under trusted text, and the verdict."""
    return kneser_ney.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


_TURNS_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
asked AS (SELECT t.conv_id, arg_max(text, turn) AS echo FROM t JOIN last USING (conv_id)
          WHERE role = 'user' AND turn < last GROUP BY t.conv_id),
r AS (SELECT t.conv_id, turn, last, role, replace(text, '<|', '< |') AS text,
             replace(CASE WHEN turn = last AND role = 'assistant' THEN coalesce(echo, '') ELSE text END,
                     '<|', '< |') AS other
      FROM t JOIN last USING (conv_id) LEFT JOIN asked USING (conv_id) WHERE turn <= last),
w AS (SELECT *, bool_or(turn = last AND text <> other) OVER (PARTITION BY conv_id) AS differ FROM r)
SELECT conv_id AS pair_id,
       count(*) FILTER (WHERE turn < last OR NOT differ) AS prompt_turns,
       NOT bool_or(differ) AS tied,
       coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn)
                FILTER (WHERE turn < last OR NOT differ), '') AS prompt,
       coalesce(max('<|assistant|>' || chr(10) || text || '<|end|>' || chr(10))
                FILTER (WHERE turn = last AND differ), '') AS chosen,
       coalesce(max('14:' || (14 + length(text) + 8)) FILTER (WHERE turn = last AND differ), '') AS chosen_mask,
       coalesce(max('<|assistant|>' || chr(10) || other || '<|end|>' || chr(10))
                FILTER (WHERE turn = last AND differ), '') AS rejected,
       coalesce(max('14:' || (14 + length(other) + 8)) FILTER (WHERE turn = last AND differ), '') AS rejected_mask
FROM w GROUP BY conv_id
"""


@query("op8_chat_formatting", _TURNS_SQL)
def op8(spark, sf_dir):
    """Every conversation as a preference pair against an echoed last reply."""
    return preferences.format_pairs(*preferences.echo_pairs(table(spark, sf_dir, "conversations")))


@query("op11_fingerprints")
def op11(spark, sf_dir):
    """Fingerprints of every document and of its text edited towards its successor."""
    return fingerprints.edited(documents(spark, sf_dir))


_TRIE_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                     length(coalesce(text, '')), text) AS no
           FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base,
               xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
                   list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                   lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                            lambda s, z: xor(s >> 1, 3988292384 * (s & 1))))) % 6 AS h
        FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.n, c.base, c.h, least(c.h, coalesce(o.n, 0)) AS k
      FROM crc c LEFT JOIN crc o ON o.conv_id = c.base),
r AS (SELECT k.conv_id, t.no AS depth, role, text FROM k JOIN t ON t.conv_id = k.base AND t.no <= k.k
      UNION ALL
      SELECT k.conv_id, k.k + t.no - k.h, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.no > k.h),
p AS (SELECT conv_id, depth, length(text) AS chars,
             string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '')
                 OVER (PARTITION BY conv_id ORDER BY depth) AS key
      FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM k),
q AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS above,
             depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
g AS (SELECT depth, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
      FROM q GROUP BY depth, key),
c AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
n AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (depth, key)),
s AS (SELECT p.depth, p.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
             sum((n_convs - 1) * n.chars)::BIGINT AS saved_tokens
      FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s USING (depth, key) LEFT JOIN g u ON u.depth = n.depth - 1 AND u.key = n.above
"""


@query("op12_prefix_trie", _TRIE_SQL)
def op12(spark, sf_dir):
    """Every prefix shared or owned by the conversations rebuilt on a common start."""
    t = prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))
    return prefix_trie.ends_digest(t).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                             "saved_tokens", "ends_sha256")


@query("op13_whitening")
def op13(spark, sf_dir):
    """Leading whitened components of every embedding. A deviation that does not
    fit a long is null."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.col("deviation").try_cast("long"))
