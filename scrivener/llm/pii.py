"""Personal data by weak supervision.

Candidate spans come from loose patterns (email, IP address, card, phone, also
spelled-out emails, phones without a plus, IPv6 addresses, secrets and social
security numbers). Five labelers look at a candidate and vote yes, no or
abstain: the strict pattern, a checksum or range, a gazetteer, the words
before it, and the characters around it. Expectation-maximisation over the
vote patterns estimates what each labeler's votes are worth and gives a
probability per candidate; a logistic span classifier is then trained on span
features against those probabilities. Base spans (the strict patterns with
their digit, octet and Luhn checks) always stay; a further candidate is added
if the classifier gives it ``THRESHOLD`` or more and it meets no base span. A
secret may hold one (an address that is a password): it is more than that span.

DataFrame functions only. Candidates are found in the row; EM and classifier
train on tables of distinct patterns (bounded by the number of votes and
binary features), one aggregate a step. Positions are code points from 0, the
end exclusive: matches and the pieces between them, from the same pattern,
give the offsets.

Edge cases: a null or empty text has no span (zero counts, the SHA-256 of the
empty string, empty ``spans``). Very long runs of one character class are
linear (possessive patterns). Spans that start together are ordered by kind as
listed in KINDS. Repeated rows get equal results; an empty table an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import let, stored

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
# A possessive form of each base pattern finds the same leftmost matches: a
# run can only match from its first character, or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What the text must hold for the pattern to be tried at all.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?i:at)\x20?[\])]\x20?"
              r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?i:dot)\x20?[\])]\x20?)[A-Za-z0-9-]++)++"),
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?i:password|passwd|secret|api[_-]?key|token)\x20?[=:]\x20?[\x21-\x7E]{6,}+",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
LOOSE_HINT = {"email": r"(?i)[\[(]\x20?at\x20?[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "phone": r"[0-9]{3}",
              "secret": r"(?i)password|passwd|secret|api[_-]?key|token", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
# Top-level domains, card issuer prefixes and cue words.
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|us|co"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CUES = (r"(?i)(?:mail|contact|write|phone|tel|call|fax|mobile|card|visa|credit|account|host|server|"
        r"address|ssn|social|password|secret|token|key|from|to)\W*$")
NOT_CUES = r"(?i)(?:version|license|section|chapter|page|isbn|figure|price|total|no|id)\W*$"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
LABELERS = ("strict", "checksum", "gazetteer", "context", "edges")
EM_STEPS = 15
FIT_STEPS = 25
PRIOR = 100.0            # pseudo candidates of each estimate
THRESHOLD = 0.5
NEAR = 24                # characters of context looked at
STEP = 512               # matches of a text placed at a time


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string is a multiple of ten."""
    d = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: let(
        F.substring(d, i, F.lit(1)).cast("int") * (2 - i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    """A base match of ``kind`` passes its check."""
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, keep) -> Column:
    """array<struct<s, e, m>> of the matches that ``keep`` accepts."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern), lambda x: F.length(x))

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def place(mg: Column) -> Column:
        m, g = mg["m"], mg["g"]

        def step(a: Column, i: Column) -> Column:
            one, start = F.get(m, i), a["at"] + F.get(g, i)
            span = F.struct(start.alias("s"), (start + F.length(one)).alias("e"), one.alias("m"))
            return F.struct((start + F.length(one)).alias("at"),
                            F.when(keep(one), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        def block(a: Column, first: Column) -> Column:
            last = F.least(first + STEP, F.size(m)) - 1
            own = F.aggregate(F.sequence(first, last), F.struct(a["at"].alias("at"), none.alias("out")), step)
            return let(own, lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], x["out"]).alias("out")))

        # an array grows by copying it: in blocks, a text of many matches does so seldom
        walked = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1, F.lit(STEP)),
                             F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda a: a["out"])
        return F.when(F.size(m) == 0, none).otherwise(walked)

    return let(F.struct(matches.alias("m"), gaps.alias("g")), place)


_SPANS = "array<struct<s:int,e:int,m:string,kind:int,base:boolean>>"


def _spans(text: Column) -> Column:
    """All candidates of a text; base spans are marked."""
    none = F.array().cast(_SPANS)

    def found(kind: str, pattern: str, keep, base: bool, hint: Column | None) -> Column:
        spans = F.transform(_located(text, pattern, keep), lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(base).alias("base")))
        return spans if hint is None else F.when(hint, spans).otherwise(none)

    digit = text.rlike("[0-9]")
    parts = []
    for k, p in BASE.items():
        hint = digit if k != "email" else F.lit(True)
        hint = hint & F.contains(text, F.lit(HINT[k])) if HINT[k] else hint
        parts.append(found(k, p, lambda m, k=k: _holds(k, m), True, hint))
    for k, p in LOOSE.items():
        parts.append(found(k, p, lambda m: F.lit(True), False, text.rlike(LOOSE_HINT[k])))

    def without_met(all_: Column) -> Column:
        base = F.filter(all_, lambda x: x["base"])
        return let(base, lambda b: F.filter(all_, lambda x: x["base"] | ~F.exists(
            b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])
            & ((x["kind"] != KINDS.index("secret")) | (y["kind"] == x["kind"])))))

    return let(F.concat(*parts), lambda a: F.when(F.size(a) == 0, none).otherwise(without_met(a)))


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, F.lit(1))
    if no is not None:
        v = v.when(no, F.lit(-1))
    return v.otherwise(F.lit(0))


def _labels(c: Column, before: Column, after: Column) -> Column:
    """Struct of the labelers' votes on candidate ``c`` and its span features."""
    m, kind = c["m"], c["kind"]
    is_ = {k: kind == i for i, k in enumerate(KINDS)}
    digits = _digits(m)
    good_sum = F.when(is_["card"], c["base"]).when(is_["ip"], c["base"] | m.contains(":")).when(
        is_["phone"], F.length(digits).between(9, 15)).when(
        is_["secret"], m.rlike(r"[=:].*[0-9]") & m.rlike(r"[=:].*[A-Za-z]"))
    listed = F.when(is_["email"], m.rlike(rf"(?i)[.\])\x20](?:{DOMAINS})$")).when(
        is_["card"], digits.rlike(ISSUERS)).when(
        is_["ip"], ~m.rlike(r"^(?:0|127|255)\.")).when(is_["ssn"], ~m.rlike("^(?:000|666|9)")).when(
        is_["secret"], m.rlike(r"(?i)^(?:password|passwd|secret|api[_-]?key|token)="))
    open_ = before.rlike(r"(?:^|[\s(\[{<\"':=,;])$") & after.rlike(r"^(?:$|[\s)\]}>\"'.,;:!?])")
    votes = {
        "strict": _vote(c["base"], F.lit(False)),
        "checksum": _vote(F.coalesce(good_sum, F.lit(False)), F.coalesce(~good_sum, F.lit(False))),
        "gazetteer": _vote(F.coalesce(listed, F.lit(False)), F.coalesce(~listed, F.lit(False))),
        "context": _vote(before.rlike(CUES), before.rlike(NOT_CUES)),
        "edges": _vote(open_, ~open_),
    }
    features = {
        **{f"is_{k}": v for k, v in is_.items()},
        "long": F.length(m) >= 12, "spaced": m.contains(" "), "letters": m.rlike("[A-Za-z]"),
        "many_digits": F.length(digits) >= 9, "closed": ~open_, "after_space": before.rlike(r"\s$"),
    }
    return F.struct(*[v.alias(k) for k, v in votes.items()],
                    *[v.cast("int").alias(f"f_{k}") for k, v in features.items()])


FEATURES = [f"f_is_{k}" for k in KINDS] + [f"f_{k}" for k in (
    "long", "spaced", "letters", "many_digits", "closed", "after_space")]


def candidates(text: Column) -> Column:
    """array<struct<s, e, kind, base, x>>: spans, votes and features of a text."""
    t = F.coalesce(text, F.lit(""))
    return F.transform(_spans(t), lambda c: F.struct(
        c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), c["base"].alias("base"),
        _labels(c, F.substring(t, F.greatest(c["s"] - NEAR, F.lit(0)) + 1, F.least(c["s"], F.lit(NEAR))),
                F.substring(t, c["e"] + 1, F.lit(2))).alias("x")))


def fit_labelers(patterns: DataFrame) -> dict | None:
    """EM over vote patterns (columns LABELERS and n): per labeler and vote the
    probability on true and on false candidates. Starts from majority votes;
    the prior says labelers are better than chance."""
    total = sum((F.col(c) for c in LABELERS), F.lit(0))
    post = 1 / (1 + F.exp(-1.5 * total))
    model = None
    for _ in range(EM_STEPS):
        p = patterns.withColumn("_p", post)
        sums = [F.sum("n").alias("all"), F.sum(F.col("n") * F.col("_p")).alias("true")]
        for c in LABELERS:
            for v in (-1, 0, 1):
                hit = F.when(F.col(c) == v, F.col("n")).otherwise(0)
                sums += [F.sum(hit).alias(f"{c}{v}"), F.sum(hit * F.col("_p")).alias(f"{c}{v}t")]
        row = p.agg(*sums).first()
        if not row["all"]:
            return None
        n, t = float(row["all"]), row["true"]
        s = PRIOR
        model = {"prior": (t + s) / (n + 2 * s), "votes": {}}
        for c in LABELERS:
            for v, yes, no in ((-1, 0.1, 0.5), (0, 0.2, 0.4), (1, 0.7, 0.1)):
                g = row[f"{c}{v}t"]
                model["votes"][c, v] = ((g + s * yes) / (t + s), (row[f"{c}{v}"] - g + s * no) / (n - t + s))
        logit = F.lit(math.log(model["prior"] / (1 - model["prior"])))
        for (c, v), (yes, no) in model["votes"].items():
            logit = logit + F.when(F.col(c) == v, F.lit(math.log(yes / no))).otherwise(F.lit(0.0))
        post = 1 / (1 + F.exp(-logit))
    return {**model, "posterior": post}


def fit_classifier(patterns: DataFrame) -> dict[str, float]:
    """Logistic regression of ``p`` (weight n) on the binary FEATURES, by steps
    along each coordinate that a bound on the curvature keeps from overshooting."""
    names = ["bias", *FEATURES]
    w = dict.fromkeys(names, 0.0)
    x = {"bias": F.lit(1), **{f: F.col(f) for f in FEATURES}}
    for _ in range(FIT_STEPS):
        z = sum((F.lit(w[k]) * x[k] for k in names), F.lit(0.0))
        err = F.col("n") * (F.col("p") - 1 / (1 + F.exp(-z)))
        row = patterns.agg(*[F.sum(err * x[k]).alias(f"g_{k}") for k in names],
                           *[F.sum(F.col("n") * x[k]).alias(f"n_{k}") for k in names]).first()
        if not row["n_bias"]:
            break
        active = 6       # features of a candidate that are 1, bias included, at most in practice
        for k in names:
            if row[f"n_{k}"]:
                w[k] += row[f"g_{k}"] / (0.25 * active * row[f"n_{k}"])
    return w


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of base spans by kind, the hash of the base spans
    and all spans."""
    held = stored(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), candidates(F.col(f"`{text}`")).alias("c")),
                  "candidates")
    rows = held.select(F.explode("c").alias("c")).select("c.x.*")
    # the distinct patterns of votes and features: bounded, whatever the corpus
    patterns = stored(rows.groupBy(*LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).coalesce(1)
                      .sortWithinPartitions(*LABELERS, *FEATURES), "patterns")
    labelers = fit_labelers(patterns)
    if labelers is None:
        weights = dict.fromkeys(["bias", *FEATURES], 0.0)
    else:
        weights = fit_classifier(patterns.withColumn("p", labelers["posterior"]))

    def score(x: Column) -> Column:
        z = sum((F.lit(weights[f]) * x["x"][f] for f in FEATURES), F.lit(weights["bias"]))
        return 1 / (1 + F.exp(-z))

    order = F.sort_array(F.transform("c", lambda x: F.struct(
        x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), x["base"].alias("base"),
        (x["base"] | (score(x) >= THRESHOLD)).alias("taken"))))

    def listing(spans: Column) -> Column:
        name = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.get(name, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["base"])

    def of_kind(i: int) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == i)).cast("long")

    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return held.select("doc_id", order.alias("spans")).select(
        "doc_id", *counts, F.sha2(listing(base), 256).alias("base_sha256"),
        listing(F.filter(spans, lambda x: x["taken"])).alias("spans"))
