"""Quality rules by weak supervision.

Each rule looks at counts of a document and votes good (+1), bad (-1) or
abstains (0). Expectation-maximisation over the vote patterns estimates, for
every rule, how often it votes each way on good and on bad documents; the
posterior probability of "good" then decides, instead of "all rules must
pass". A rule that seldom fires but is right when it does (symbols, capitals)
so outweighs many weak good votes.

DataFrame functions only. One pass over the texts makes the counts; EM runs on
the table of distinct vote patterns (at most 3 ** number of rules rows).

Edge cases: a null or empty text has no words: all counts 0, ``base_failed``,
not kept. An empty table gives an empty result. Repeated rows are judged
alike, as the verdict depends on the counts alone; a tie (posterior exactly at
the threshold) is kept. Extra columns pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import fresh, let, stored, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5               # words in a repeated window
MIN_WORDS = 10           # base rule: fewer fails
MAX_REPEAT_PCT = 20      # base rule: more words in repeated windows fails
EM_STEPS = 20
# Prior of the EM: votes (bad, abstain, good) of a rule on good and on bad
# documents, counted as PRIOR_DOCS documents of either class: it carries small
# tables and keeps rates above zero; in a larger one the votes set the rates.
PRIOR_GOOD = (0.002, 0.148, 0.85)
PRIOR_BAD = (0.15, 0.15, 0.70)
PRIOR_DOCS = 100.0
PRIOR_CLASS = 0.005      # pseudo rows of either class, as a share of all rows
THRESHOLD = 0.5          # posterior of "good" from which a document is kept


def repeated_words(w: Column) -> Column:
    """Words of ``w`` that lie in a 5-word window found twice or more (the
    first one included). Windows are compared by a 64-bit hash; equal ones are
    found by sorting (hash, position)."""
    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.aggregate(
            F.sort_array(F.transform(
                F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"])),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, p: F.struct(p.alias("last"),
                                  (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
            lambda a: a["n"]))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def count(h: Column) -> Column:
        return let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0))
                   .otherwise(covered(g)))

    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(
        let(F.transform(w, lambda x: F.xxhash64(x)), count))


def _removed(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def counts(text: Column) -> Column:
    """Struct of the counts the rules look at (all long)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).alias("n"), repeated_words(w).alias("repeat"),
        F.size(F.array_distinct(w)).alias("distinct"),
        F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}"))).alias("odd")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    cols = {
        "words": of_words,
        "lines": of_lines,
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": _removed(t, SYMBOLS),
        "n_marks": _removed(t, "!"),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
        "n_letters": F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", "")),
    }
    return F.struct(*[c.alias(k) for k, c in cols.items()])


def flat(c: str) -> dict[str, Column]:
    """The counts by name, from the struct column ``c``."""
    at = {"n_words": "words.n", "word_chars": "word_chars", "n_symbols": "n_symbols",
          "n_dup_lines": "lines.dup", "n_repeat_words": "words.repeat", "n_lines": "lines.n",
          "n_distinct": "words.distinct", "n_odd": "words.odd", "n_marks": "n_marks", "n_upper": "n_upper",
          "n_letters": "n_letters"}
    return {k: F.col(f"{c}.{v}").cast("long") for k, v in at.items()}


def base_failed(n: dict[str, Column]) -> Column:
    return (n["n_words"] < MIN_WORDS) | (100 * n["n_repeat_words"] > MAX_REPEAT_PCT * n["n_words"])


def votes(n: dict[str, Column]) -> dict[str, Column]:
    """Rule name -> vote. Whole-number comparisons only; a document without
    words gets bad or abstaining votes."""
    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    w = n["n_words"]
    return {
        "length": vote(w < MIN_WORDS, w >= 50),
        "symbols": vote(10 * n["n_symbols"] > w, (50 * n["n_symbols"] <= w) & (w > 0)),
        "repeats": vote(100 * n["n_repeat_words"] > MAX_REPEAT_PCT * w,
                        (100 * n["n_repeat_words"] <= 5 * w) & (w > 0)),
        "dup_lines": vote((10 * n["n_dup_lines"] > 3 * n["n_lines"]) & (n["n_dup_lines"] > 1),
                          (n["n_dup_lines"] == 0) & (n["n_lines"] > 1)),
        "capitals": vote(10 * n["n_upper"] > 3 * n["n_letters"],
                         (10 * n["n_upper"] <= n["n_letters"]) & (w > 0)),
        "marks": vote(10 * n["n_marks"] > 3 * w, (50 * n["n_marks"] <= w) & (w > 0)),
        "word_length": vote((10 * n["word_chars"] < 25 * w) | (n["word_chars"] > 12 * w),
                            (n["word_chars"] >= 3 * w) & (n["word_chars"] <= 10 * w) & (w > 0)),
        "letters": vote(100 * n["n_letters"] < 75 * n["word_chars"],
                        (100 * n["n_letters"] >= 85 * n["word_chars"]) & (w > 0)),
        "letter_words": vote(10 * n["n_odd"] > 2 * w, (20 * n["n_odd"] <= w) & (w > 0)),
        "variety": vote((w >= 50) & (10 * n["n_distinct"] < w), 4 * n["n_distinct"] >= w),
    }


def fit(patterns: DataFrame, rules: list[str], weight: str = "n",
        steps: int = EM_STEPS) -> dict | None:
    """EM over the distinct vote patterns, each step one aggregate.

    Returns the prior of "good" and, for rule and vote, the probabilities
    under good and bad; None for an empty table. It starts from "a document
    with any bad vote is bad"; the class that holds more of that start's good
    is called good."""
    some_bad = F.greatest(*[F.when(F.col(r) == -1, 1).otherwise(0) for r in rules]) == 1
    start = F.when(some_bad, F.lit(0.1)).otherwise(F.lit(0.95))
    post = start
    model, turned = None, False
    for _ in range(steps):
        p = patterns.select(*rules, F.col(weight).cast("double").alias("_n"), post.alias("_p"), start.alias("_s"))
        sums = [F.sum("_n").alias("all"), F.sum(F.col("_n") * F.col("_p")).alias("good"),
                F.sum(F.col("_n") * F.col("_s")).alias("start"),
                F.sum(F.col("_n") * F.col("_p") * F.col("_s")).alias("agree")]
        for r in rules:
            for v in (-1, 0, 1):
                hit = F.when(F.col(r) == v, F.col("_n")).otherwise(0.0)
                sums += [F.sum(hit).alias(f"{r}{v}"), F.sum(hit * F.col("_p")).alias(f"{r}{v}g")]
        row = p.agg(*sums).first()
        if not row["all"]:
            return None
        n, good = row["all"], row["good"]
        s = PRIOR_CLASS * n
        # "good" has less of the start's good than all rows have (not by rounding alone)
        turned = row["agree"] * n < (1 - 1e-6) * good * row["start"]
        new = {"prior": (good + s) / (n + 2 * s), "rules": {}}
        for r in rules:
            for v in (-1, 0, 1):
                g, every = row[f"{r}{v}g"], row[f"{r}{v}"]
                new["rules"][r, v] = ((g + PRIOR_DOCS * PRIOR_GOOD[v + 1]) / (good + PRIOR_DOCS),
                                      (every - g + PRIOR_DOCS * PRIOR_BAD[v + 1]) / (n - good + PRIOR_DOCS))
        moved = 1.0 if model is None else max(
            abs(a - b) for k in new["rules"] for a, b in zip(new["rules"][k], model["rules"][k]))
        model = new
        post = posterior(model, {r: F.col(r) for r in rules})
        if moved < 1e-4:
            break
    if turned:
        model = {"prior": 1 - model["prior"], "rules": {k: (b, g) for k, (g, b) in model["rules"].items()}}
    return model


def posterior(model: dict, votes_: dict[str, Column]) -> Column:
    """Probability of "good" given the votes."""
    logit = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, c in votes_.items():
        for v in (-1, 0, 1):
            g, b = model["rules"][r, v]
            logit = logit + F.when(c == v, F.lit(math.log(g / b))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-logit))


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (its columns ``keep``, all by default) with a struct column of
    the counts, ``base_failed``, ``posterior`` and ``kept``. Returns the frame
    and the struct column's name."""
    q, v = fresh(docs, "quality"), fresh(docs, "votes")
    keep = docs.columns if keep is None else keep
    counted = docs.select(*[F.col(f"`{c}`") for c in keep], counts(F.col(f"`{text}`")).alias(q))
    rules = votes(flat(q))
    counted = stored(counted.withColumn(v, F.struct(*[c.alias(r) for r, c in rules.items()])), "quality")
    patterns = stored(counted.groupBy(F.col(v)).count().select(f"{v}.*", F.col("count").alias("n"))
                      .coalesce(1).sortWithinPartitions(*rules), "patterns")
    model = fit(patterns, list(rules))
    post = F.lit(None).cast("double") if model is None else posterior(
        model, {r: F.col(f"{v}.{r}") for r in rules})
    n = flat(q)
    failed = base_failed(n)
    out = counted.withColumn(q, F.struct(
        *[c.alias(k) for k, c in n.items()], failed.alias("base_failed"), post.alias("posterior"),
        (~failed & F.coalesce(post >= THRESHOLD, F.lit(False))).alias("kept")))
    return out.drop(v), q


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents the rules keep, with all their columns."""
    judged, q = judge(docs, text)
    return judged.where(F.col(f"{q}.kept")).drop(q)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its counts and the verdict."""
    judged, q = judge(docs, text, keep=[doc_id])
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "kept", "posterior"]
    return judged.select(F.col(f"`{doc_id}`").alias("doc_id"), *[f"{q}.{c}" for c in out])
