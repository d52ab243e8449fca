"""Operator 8: personal data by weak supervision. DataFrame functions only.

Regular expressions propose spans; four labelers (strict form, gazetteer, context, shape) vote on each:
for, against, or no opinion. Expectation-maximisation over the counts of vote patterns, gathered from
every candidate of every text, estimates how reliable each labeler is and how common each kind; a logistic classifier
over the votes, the kind and features of the span itself (length, share of digits, different characters, what stands
at its ends) is trained on the resulting soft labels and decides about candidates outside the base rules. Base spans
always stay. Counts by kind, votes and features are the only thing the driver sees: their number is bounded by the
steps of the features, whatever the input.

Positions: the gaps (``split``) and matches (``regexp_extract_all``) of a text alternate, so the running
sum of their lengths gives code-point offsets. The sum is a window over exploded matches, linear in their
number. Patterns are possessive and anchored with a look-behind, so long runs cost linear time.

Defined results: a null or empty text has no span; the patterns run in linear time over very long texts; rows that
repeat doc_id and text give equal rows; null doc_ids are kept; of candidates of one place, a base span stays and then the
first by start and kind; with no rows the result is empty; other columns are not touched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed, text_key, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "ssn", "secret")
#: The base rules, written so that Java's matcher finds the same leftmost matches without backtracking.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?:password|passwd|secret|token|api_key)[=:][^\x20\x09-\x0D]{8,}+|[0-9a-f]{40})(?![A-Za-z0-9])",
}
#: In every match of the kind; a cheap test before the pattern.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
#: Gazetteers: top-level domains, telephone country codes, words of context.
DOMAINS = "com org net edu gov info biz io co de fr es it uk eu us ca jp cn in au nl ch at be se no dk fi pl pt br mx".split()
COUNTRIES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CONTEXT = "mail|contact|write|call|phone|tel|fax|mobile|card|visa|credit|server|host|address|login|user|password|secret|key|token|social"
LABELERS = ("strict", "gazetteer", "context", "shape")
#: Features of a span and their number of steps.
FEATURES = {"size": 8, "digits": 5, "different": 6, "edges": 4}


def matches(docs: DataFrame, context: int = 24) -> DataFrame:
    """All pattern matches: doc_id, row_key, kind, start, end, match, before, after."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        worth = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        rows = rows.withColumn(f"m_{kind}", F.when(worth, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))
    def listed(k: int, kind: str) -> Column:
        n = F.size(f"m_{kind}")
        zipped = F.arrays_zip(F.col(f"m_{kind}").alias("m"), F.slice(f"g_{kind}", 1, n).alias("g"), F.slice(f"g_{kind}", 2, n + 1).alias("a"))
        return F.transform(zipped, lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("idx"), F.length(x["g"]).alias("gap"), x["m"].alias("match"), F.right(x["g"], F.lit(context)).alias("before"), F.left(x["a"], F.lit(context)).alias("after")))

    found = [listed(k, kind) for k, kind in enumerate(KINDS)]
    hits = rows.select("doc_id", "row_key", F.explode(F.concat(*found)).alias("hit")).select("doc_id", "row_key", "hit.*")
    hits = hits.dropDuplicates(["doc_id", "row_key", "kind", "idx"])
    upto = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("doc_id", "row_key", "kind").orderBy("idx"))
    return hits.select("doc_id", "row_key", "kind", (upto - F.length("match")).alias("start"), upto.alias("end"), "match", "before", "after")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def voted(hits: DataFrame) -> DataFrame:
    """Adds base (the span is one of the base rules) and a vote (1, 0, -1) of each labeler."""
    kind = lambda *names: F.col("kind").isin([KINDS.index(n) for n in names])
    digits = F.regexp_replace("match", "[^0-9]", "")
    parts = F.transform(F.split("match", r"\."), lambda x: x.cast("double"))
    in_range = ~F.exists(parts, lambda x: x > 255)
    luhn = _luhn(digits)
    n = F.length(digits)
    base = F.when(kind("email"), True).when(kind("ip"), in_range).when(kind("card"), n.between(16, 19) & luhn).when(kind("phone"), n.between(8, 15)).otherwise(False)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    m = F.col("match")
    strict = (
        F.when(kind("email"), m.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"))
        .when(kind("ip"), in_range & ~m.rlike(r"(^|\.)0[0-9]"))
        .when(kind("card"), n.between(16, 19) & luhn)
        .when(kind("phone"), n.between(8, 15) & m.rlike(r"^\+[1-9]"))
        .when(kind("ssn"), ~m.rlike(r"^(000|666|9)|-00-|-0000$"))
        .when(kind("local_phone"), m.rlike(r"^\(?[2-9]"))
        .otherwise(m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    )
    gazetteer = (
        F.when(kind("email"), F.lower(F.substring_index(m, ".", -1)).isin(DOMAINS).cast("int"))
        .when(kind("ip"), F.when(m.rlike(r"^(0|127|255)\."), -1).otherwise(0))
        .when(kind("card"), vote(digits.rlike("^(4|5[1-5]|3[47]|6011|65)"), digits.rlike("^[01789]")))
        .when(kind("phone"), vote(F.substring(digits, 1, 1).isin(COUNTRIES) | F.substring(digits, 1, 2).isin(COUNTRIES), digits.startswith("0")))
        .when(kind("secret"), m.rlike("^(AKIA|password|passwd|secret|token|api_key)").cast("int"))
        .otherwise(0)
    )
    near = F.lower(F.concat("before", F.lit(" "), "after"))
    glued = F.col("before").rlike("[A-Za-z0-9_]$") | F.col("after").rlike("^[A-Za-z0-9_]")
    context = vote(near.rlike(CONTEXT), glued)
    shape = vote(F.size(F.array_distinct(F.split(m, ""))) >= 4, F.size(F.array_distinct(F.split(digits, ""))) <= 1)
    votes = [F.when(strict, 1).otherwise(-1).alias("strict"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape")]
    open_left, open_right = F.col("before").rlike(r"(^|[\s(\[{<\"':;,=])$"), F.col("after").rlike(r"^($|[\s)\]}>\"':;,.!?])")
    features = {
        "size": F.floor(F.log2(F.length(m).cast("double"))),
        "digits": F.floor(4 * n / F.length(m)),
        "different": F.floor(F.size(F.array_distinct(F.split(m, ""))) / 4),
        "edges": open_left.cast("int") * 2 + open_right.cast("int"),
    }
    return hits.select("*", F.coalesce(base, F.lit(False)).alias("base"), *votes, *[F.least(v, F.lit(FEATURES[k] - 1)).cast("int").alias(k) for k, v in features.items()])


def _posterior(votes: tuple[int, ...], prior: float, rates: list[dict]) -> float:
    yes, no = math.log(prior), math.log(1 - prior)
    for v, r in zip(votes, rates):
        yes, no = yes + math.log(r[v][1]), no + math.log(r[v][0])
    return 1 / (1 + math.exp(min(50.0, no - yes)))


def estimate(patterns: list[tuple], rounds: int = 30) -> dict[tuple, float]:
    """Expectation-maximisation: the probability of each (kind, votes) from [(kind, votes, count)]."""
    rates = [{1: [0.2, 0.7], 0: [0.3, 0.2], -1: [0.5, 0.1]} for _ in LABELERS]
    prior = {k: 0.5 for k, _, _ in patterns}
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        post = {(k, v): _posterior(v, prior[k], rates) for k, v, _ in patterns}
        for k in prior:
            own = [(post[kk, v], c) for kk, v, c in patterns if kk == k]
            prior[k] = min(0.99, max(0.01, (1 + sum(p * c for p, c in own)) / (2 + sum(c for _, c in own))))
        for j, rate in enumerate(rates):
            for y in (0, 1):
                mass = {x: 1.0 for x in (1, 0, -1)}
                for k, v, c in patterns:
                    mass[v[j]] += c * (post[k, v] if y else 1 - post[k, v])
                for x in mass:
                    rate[x][y] = mass[x] / sum(mass.values())
    return post


def _active(kind: int, votes: tuple[int, ...], features: tuple[int, ...]) -> list[int]:
    """Places of the weights that are summed for a span: bias, kind, each vote but no opinion, each feature's step."""
    at, out = 1, [0, 1 + kind]
    at += len(KINDS)
    for v in votes:
        out += [at + (v < 0)] * (v != 0)
        at += 2
    for v, steps in zip(features, FEATURES.values()):
        out.append(at + v)
        at += steps
    return out


def train(patterns: list[tuple], soft: dict[tuple, float], rounds: int = 200, rate: float = 2.0) -> list[float]:
    """Weights of the span classifier on the soft labels, by full-batch descent over (kind, votes, features, count)."""
    w = [0.0] * (1 + len(KINDS) + 2 * len(LABELERS) + sum(FEATURES.values()))
    rows = [(_active(k, v, f), soft[k, v], math.sqrt(c)) for k, v, f, c in patterns]
    total = sum(c for _, _, c in rows) or 1.0
    for _ in range(rounds):
        grad = [1e-3 * x for x in w]
        for active, y, c in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[j] for j in active)))))
            for j in active:
                grad[j] += c * (p - y) / total
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def _logit(w: list[float]) -> Column:
    """The sum of a row's weights, by look-ups in arrays of constants."""
    pick = lambda part, at: F.element_at(F.array(*[F.lit(x) for x in part]), (at + 1).cast("int"))
    at = 1 + len(KINDS)
    z = F.lit(w[0]) + pick(w[1:at], F.col("kind"))
    for name in LABELERS:
        z = z + F.when(F.col(name) > 0, w[at]).when(F.col(name) < 0, w[at + 1]).otherwise(0.0)
        at += 2
    for name, steps in FEATURES.items():
        z = z + pick(w[at : at + steps], F.col(name))
        at += steps
    return z


def find(docs: DataFrame) -> DataFrame:
    """Spans: doc_id, row_key, kind, start, end, match, base, score; one set for each (doc_id, row_key).

    Spans of the method that overlap a base span are left out.
    """
    cand = written(voted(matches(docs)))
    counts = cand.groupBy("kind", *LABELERS, *FEATURES).count().collect()
    patterns = [(r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r["count"]) for r in sorted(counts)]
    voted_: dict[tuple, int] = {}
    for k, v, _, c in patterns:
        voted_[k, v] = voted_.get((k, v), 0) + c
    z = _logit(train(patterns, estimate([(k, v, c) for (k, v), c in voted_.items()])))
    score = F.round(1 / (1 + F.exp(-z)), 6)
    around = Window.partitionBy("doc_id", "row_key").orderBy("start", "kind")
    own = lambda c: F.when(F.col("base"), F.col(c))
    spans = cand.where("end is not null").withColumn("score", score).where("base or score >= 0.5")
    spans = spans.withColumn("covered", F.max(own("end")).over(around.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("next", F.min(own("start")).over(around.rowsBetween(1, Window.unboundedFollowing)))
    free = F.col("base") | ((F.coalesce("covered", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
    return spans.where(free).select("doc_id", "row_key", "kind", "start", "end", "match", "base", "score")


def redact(docs: DataFrame, mark: str = "█") -> DataFrame:
    """The documents with every span's characters replaced; one join on (doc_id, row_key)."""
    per = find(docs).groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")).toDF("id", "key", "spans")
    rows, own = renamed(docs)
    text = F.col(own["text"])
    rows = rows.join(per, F.col(own["doc_id"]).eqNullSafe(F.col("id")) & (text_key(text) == F.col("key")), "left")
    hidden = F.aggregate("spans", text, lambda t, s: F.overlay(t, F.repeat(F.lit(mark), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))
    return rows.select(*[(F.when(F.col("spans").isNull(), text).otherwise(hidden) if c == "text" else F.col(n)).alias(c) for c, n in own.items()])
