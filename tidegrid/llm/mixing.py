"""Document rates that bring a corpus to target token totals per domain, with soft domain membership."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.shared import cut, pin

#: Labelled rows that the classifier is fitted on at most, and hash buckets of its word features.
LABELLED_ROWS, BUCKETS = 6000, 1 << 17
#: A bucket speaks for or against a domain only if its count is that many standard deviations off.
SIGNIFICANT = 4.5
#: Candidate sharpness of the posteriors; the best on rows kept from the fit is taken.
SHARPNESS = (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0)
TOLERANCE, ROUNDS = 1e-9, 60


def buckets(text: Column, n: int = BUCKETS) -> Column:
    """The hash buckets of a text's words (lower case, white space between); null: none."""
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\f\r", "     ")
    return F.transform(F.array_remove(F.split(flat, " "), ""), lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))


def _looked_up(places: Column, numbers: Column) -> Column:
    """The sum of numbers at some places of an array."""
    return F.aggregate(places, F.lit(0.0), lambda acc, b: acc + F.get(numbers, b))


class Classifier:
    """Naive Bayes over a text's distinct word buckets: log-odds of each domain against the first, by bucket."""

    def __init__(self, domains: list[str], prior: list[float], odds: list[list[float]], sharpness: float):
        self.domains, self.prior, self.odds, self.sharpness = domains, prior, odds, sharpness

    def with_evidence(self, words: DataFrame) -> DataFrame:
        """words with e1, e2...: the sum of log-odds over the buckets in `b`, for each domain after the first. The
        odds reach the plan as one-row subqueries of BUCKETS numbers each."""
        schema = T.StructType([T.StructField("odds", T.ArrayType(T.DoubleType(), False))])
        tables = [words.sparkSession.createDataFrame([Row(odds=odds)], schema).scalar() for odds in self.odds]
        held = words.select("*", *[t.alias(f"_odds{k}") for k, t in enumerate(tables, 1)])
        sums = [_looked_up(F.array_distinct("b"), F.col(f"_odds{k}")).alias(f"e{k}") for k in range(1, len(tables) + 1)]
        return held.select(*words.columns, *sums)

    def posteriors(self, evidence: list[Column], sharpness: float | None = None) -> list[Column]:
        """Probabilities of the domains; sharpness below 1 allows for words that are far from independent."""
        s = self.sharpness if sharpness is None else sharpness
        logits = [F.lit(self.prior[0])] + [F.lit(p) + F.lit(s) * e for p, e in zip(self.prior[1:], evidence, strict=True)]
        top = F.greatest(*logits) if len(logits) > 1 else logits[0]
        weights = [F.exp(z - top) for z in logits]
        total = reduce(lambda a, b: a + b, weights)
        return [w / total for w in weights]


def fit(docs: DataFrame, labelled: DataFrame, rows: int = LABELLED_ROWS, n: int = BUCKETS) -> Classifier:
    """Classifier from labelled(doc_id, domain), a table: at most `rows` of it, an equal share for each domain,
    chosen by a hash of doc_id.

    Three quarters of these give the counts, one quarter the sharpness. Null keys and domains and keys with
    several domains are left out; without any row all documents are of one domain, `all`.
    """
    spark = docs.sparkSession
    one = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("hi")).where("domain = hi")
    # every domain has its part of the sample, however rare it is; how common it is comes from all labels
    one = pin(one.select("doc_id", "domain", F.xxhash64("doc_id").alias("h")))
    common = {r.domain: r["count"] for r in one.groupBy("domain").count().collect()}
    domains = sorted(common)
    if not domains:
        return Classifier(["all"], [0.0], [], 0.0)
    picked = [r for d in domains for r in one.where(F.col("domain") == d).orderBy("h", "doc_id").limit(max(1, rows // len(domains))).collect()]
    few = spark.createDataFrame([(r.doc_id, r.domain, r.h % 4 == 3) for r in picked], "doc_id long, domain string, kept boolean")
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("domain", "kept", buckets(F.col("text"), n).alias("b"))
    counted = texts.where("not kept").select("domain", F.explode(F.array_distinct("b")).alias("b")).groupBy("b").agg(*[F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)])
    counted = cut(counted)  # n rows at most
    sums = counted.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(domains))]).first()
    total = np.array([sums[f"c{k}"] or 0 for k in range(len(domains))], float) + 1
    all_of = reduce(lambda a, b: a + b, [F.col(f"c{k}") for k in range(len(domains))])
    off = F.greatest(*[F.abs(F.col(f"c{k}") - all_of * s) / F.sqrt(all_of * s + 1) for k, s in enumerate(total / total.sum())], F.lit(0.0))
    odds = np.zeros((len(domains), n))
    for r in counted.where(off > SIGNIFICANT).collect():
        rate = (np.array([r[f"c{k}"] for k in range(len(domains))]) + 0.5) / (total + 0.5 * n)
        odds[:, r.b] = np.log(rate) - np.log(rate[0])
    size = np.array([common[d] for d in domains], float)
    prior = np.log((size + 1) / (size + 1).sum())
    model = Classifier(domains, prior.tolist(), odds[1:].tolist(), 1.0)
    if len(domains) > 1:
        names = [f"e{k}" for k in range(1, len(domains))]
        tried = model.with_evidence(texts.where("kept")).select("domain", *names)
        fits = []
        for s in SHARPNESS:
            p = model.posteriors([F.col(x) for x in names], s)
            right = reduce(lambda a, b: F.coalesce(a, b), [F.when(F.col("domain") == d, q) for d, q in zip(domains, p, strict=True)])
            fits.append(F.avg(F.ln(F.greatest(right, F.lit(1e-12)))))
        got = tried.agg(*[f.alias(f"f{i}") for i, f in enumerate(fits)]).first()
        model.sharpness = max(zip(got, SHARPNESS, strict=True), key=lambda x: (x[0] if x[0] is not None else -1e9, -x[1]))[1]
    return model


def _rate(p: list[Column], start: float, pulls: list[list[float]]) -> Column:
    """A document's rate after some projected gradient steps: it depends on its posteriors alone. The steps are
    data to the plan, so that its code stays the same from round to round."""

    def step(rate: Column, y: Column) -> Column:
        move = reduce(lambda a, b: a + b, [c * F.get(y, F.lit(k)) for k, c in enumerate(p)])
        return F.greatest(F.lit(0.0), rate - move)

    if not pulls:
        return F.lit(start)
    return F.aggregate(F.array(*[F.array(*[F.lit(float(v)) for v in y]) for y in pulls]), F.lit(start), step)


def solve(members: DataFrame, names: list[str], targets: np.ndarray, rounds: int = ROUNDS) -> tuple[float, list[list[float]]]:
    """Start and steps of projected-gradient least squares for members(n_tokens, *names).

    Minimises gap' W gap over rates >= 0: gap is the domains' expected token totals less the targets, W the
    inverse Gram matrix of the memberships, weighted by tokens. In variables scaled by the root of a document's
    tokens the gradient's Lipschitz constant is then 1, and a gradient step has length 1. Steps under the Gram
    matrix of the documents whose rate is above 0 are tried first and kept if they lower the objective.
    A round is one aggregation to domains x (domains + 3) / 2 numbers.
    """
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    tokens = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    if not tokens:
        return 1.0, []
    start, pulls = float(targets.sum() / tokens), []
    p = [F.col(x) for x in names]
    totals = [F.sum(F.col("n_tokens") * c * F.col("rate")).alias(f"x{i}") for i, c in enumerate(p)]
    grams = [F.sum(F.when(F.col("rate") > 0, F.col("n_tokens") * p[i] * p[j])).alias(f"g{i}_{j}") for i, j in pairs]

    def at(steps):
        got = members.select("n_tokens", *names, _rate(p, start, steps).alias("rate")).agg(*totals, *grams).first()
        gram = np.zeros((k, k))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = got[f"g{i}_{j}"] or 0.0
        return np.array([got[f"x{i}"] or 0.0 for i in range(k)]) - targets, gram

    inverse = lambda gram: np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    gap, active = at(pulls)
    metric = inverse(active)  # every rate is above 0 at the start
    first = float(gap @ metric @ gap)
    for _ in range(rounds):
        worth = float(gap @ metric @ gap)
        if np.abs(gap).max() <= TOLERANCE * max(1.0, np.abs(targets).max()):
            break
        newton, plain = inverse(active) @ gap, metric @ gap
        for pull in (newton, newton / 4, newton / 16, plain):
            steps = [*pulls, pull.tolist()]
            new_gap, new_active = at(steps)
            new_worth = float(new_gap @ metric @ new_gap)
            if new_worth < worth * 0.98:
                break
        if worth - new_worth < 1e-5 * first:
            break
        pulls, gap, active = steps, new_gap, new_active
    return start, pulls


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], budget: float = 1.0, rows: int = LABELLED_ROWS, missing: str = "error") -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, copies) for every row of docs(doc_id, text).

    targets: each domain's share of the token total to reach, budget x the tokens there are; domains that the
    labelled table does not have are an error (missing="spread": the others take their share), ones without a target
    have 0. Where no rates reach the targets
    the nearest totals are taken. copies: rate rounded up or down at random by a hash of doc_id and length,
    so that its mean is the rate.

    Texts are read once; the steps run over a table of a few numbers a document. Null and empty texts have no
    tokens and the prior's posteriors; repeated rows have equal rates; null keys stay; an empty table gives none.
    """
    model = fit(docs, labelled, rows)
    if model.domains != ["all"] and (unknown := set(targets) - set(model.domains)):
        kept = {d: s for d, s in targets.items() if d in model.domains}
        if missing != "spread" or not sum(kept.values()):
            raise ValueError(f"no labelled rows of {sorted(unknown)}")
        targets = {d: s * sum(targets.values()) / sum(kept.values()) for d, s in kept.items()}
    words = docs.select(F.col("doc_id"), buckets(F.col("text")).alias("b"))
    evidence = [f"e{i}" for i in range(1, len(model.domains))]
    seen = model.with_evidence(words).select("doc_id", F.size("b").alias("n"), *evidence)
    names = [f"p_{d}" for d in model.domains]
    post = model.posteriors([F.col(x) for x in evidence])
    members = cut(seen.select("doc_id", F.col("n").cast("long").alias("n_tokens"), *[c.alias(x) for c, x in zip(post, names, strict=True)]))
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0) * budget
    share = [sum(targets.values())] if model.domains == ["all"] else [targets.get(d, 0.0) for d in model.domains]
    start, pulls = solve(members, names, np.array(share) * total)
    rate = _rate([F.col(x) for x in names], start, pulls)
    chance = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(1 << 30)) / float(1 << 30)
    rated = members.withColumn("rate", rate)
    return rated.withColumn("copies", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def domains_of_labels(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) as (doc_id, domain): toxic, else high or low quality; null labels are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))
