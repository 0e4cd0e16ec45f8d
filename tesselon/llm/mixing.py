"""Mixing sources to target weights by soft domain membership, in DataFrame functions only.

A classifier trained on a labelled table gives each document posteriors over domains. Document rates are then fitted
so that the expected tokens of each domain, summed over rate x tokens x posterior, match the targets.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.shared import bounded_sample, free_name, stored

BUCKETS, SAMPLE, EVIDENCE, ROUNDS, TOLERANCE, REPLAYED = 1 << 16, 20000, 2.0, 240, 1e-6, 16


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def domain_model(docs: DataFrame, labelled: DataFrame, domains: list[str], buckets: int = BUCKETS, sample: int = SAMPLE) -> DataFrame:
    """``(bucket, l_0, l_1, ...)``: log-likelihood in each domain of the words that hash to a bucket, for the buckets that labelled words reach.

    ``labelled(doc_id, domain)``; at most ``sample`` labelled ids are used, taken by a hash. Every word counts, rare ones too; the
    table that is broadcast against the documents has ``buckets`` rows at most. Labels outside ``domains`` are left out.
    """
    known = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = bounded_sample(stored(known, "known"), "doc_id", sample)
    seen = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", F.explode(words_of(F.col("text"))).alias("word")).where("word <> ''")
    counts = [F.count_if(F.col("domain") == d).cast("double").alias(f"c_{k}") for k, d in enumerate(domains)]
    found = stored(seen.groupBy(bucket_of(F.col("word"), buckets).alias("bucket")).agg(*counts), "words")
    sums = found.agg(F.count("*"), *[F.sum(f"c_{k}") for k in range(len(domains))]).first()
    ratio = [F.log((F.col(f"c_{k}") + 1.0) / F.lit(float((sums[k + 1] or 0) + sums[0] + 1))).alias(f"l_{k}") for k in range(len(domains))]
    return found.select("bucket", *ratio)


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str], buckets: int = BUCKETS, evidence: float = EVIDENCE) -> DataFrame:
    """``(doc_id, tokens, p_0, p_1, ...)`` per row of ``docs``.

    The log-likelihoods of a document's known words are averaged and weighted as ``evidence`` words at most, so that
    a long document of mixed content keeps a mixed membership. Without a known word all domains are alike.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = numbered.select("row", "doc_id", F.explode_outer(words_of(F.col("text"))).alias("word")).withColumn("bucket", F.when(F.col("word") != "", bucket_of(F.col("word"), buckets)))
    sums = [F.coalesce(F.sum(f"l_{k}"), F.lit(0.0)).alias(f"s_{k}") for k in range(len(domains))]
    counted = rows.join(F.broadcast(model), "bucket", "left").groupBy("row", "doc_id").agg(
        F.count_if(F.col("word") != "").alias("tokens"), F.count("l_0").alias("known"), *sums
    )
    weight = F.least(F.col("known").cast("double"), F.lit(evidence)) / F.greatest(F.col("known"), F.lit(1))
    scaled = [(F.col(f"s_{k}") * weight).alias(f"s_{k}") for k in range(len(domains))]
    logs = counted.select("doc_id", "tokens", *scaled)
    top = F.greatest(*[F.col(f"s_{k}") for k in range(len(domains))])
    raised = logs.select("doc_id", "tokens", *[F.exp(F.col(f"s_{k}") - top).alias(f"e_{k}") for k in range(len(domains))])
    total = sum((F.col(f"e_{k}") for k in range(1, len(domains))), F.col("e_0"))
    return raised.select("doc_id", "tokens", *[(F.col(f"e_{k}") / total).alias(f"p_{k}") for k in range(len(domains))])


def exact_sum(x: Column) -> Column:
    """The sum of doubles to 2^-20, the same in whatever order partial sums meet."""
    return (F.sum((x * F.lit(float(1 << 20))).cast("decimal(38,0)")).cast("double") / F.lit(float(1 << 20)))


def fitted_rates(members: DataFrame, targets: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``members`` with ``rate``: nonnegative rates whose expected tokens per domain come closest to ``targets`` tokens.

    Projected gradient on half the squared distance of expected tokens and targets, weighted by the inverse of the
    domains' co-membership matrix S (the sum of tokens x p x p'), starting from rate 1, in the metric in which a
    document weighs its tokens. There the gradient's Lipschitz constant is 1, so the step is 1 and no line search is
    needed; targets that can be met are met. A round is one aggregation of a few numbers over the members; a
    document's rate is replayed from the gradients of the last rounds, REPLAYED at most, after which the rates are written.

    It ends when the gap to each target is within ``tolerance`` of all tokens, or when it no longer closes, as with a domain
    that no document belongs to. Gaps that stay are told in a warning, by domain.
    """
    p, n = [F.col(f"p_{k}") for k in range(len(targets))], len(targets)
    sums = members.agg(*[exact_sum(F.col("tokens") * p[i] * p[j]) for i in range(n) for j in range(n)]).first()
    shared = np.array([float(x or 0) for x in sums]).reshape(n, n)
    total, pulls, best, still = float(shared.sum()) or 1.0, [], float("inf"), 0
    weigh = np.linalg.pinv(shared / total, rcond=1e-9, hermitian=True) / total
    base = members.withColumn("rate", F.lit(1.0))

    def rate() -> Column:
        if not pulls:
            return F.col("rate")
        steps = F.array(*[F.array(*[F.lit(x) for x in pull]) for pull in pulls])
        move = lambda g: sum((p[k] * g[k] for k in range(1, n)), p[0] * g[0])
        return F.aggregate(steps, F.col("rate"), lambda r, g: F.greatest(F.lit(0.0), r - move(g)))

    for _ in range(rounds):
        now = base.withColumn("rate", rate()).agg(*[exact_sum(F.col("tokens") * x * F.col("rate")) for x in p]).first()
        gap = np.array([float(a or 0) - t for a, t in zip(now, targets)])
        size = float(gap @ weigh @ gap)
        still = 0 if size < (1 - 1e-6) * best else still + 1
        best = min(best, size)
        if np.abs(gap).max() <= tolerance * total or still == 3:
            break
        pulls.append([float(x) for x in weigh @ gap])
        if len(pulls) == REPLAYED:
            base, pulls = stored(base.withColumn("rate", rate()), "rates"), []
    if np.abs(gap).max() > tolerance * total:
        warnings.warn(f"target tokens unmet by {[round(float(-g), 3) for g in gap]}", stacklevel=2)
    return base.withColumn("rate", rate())


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0, buckets: int = BUCKETS, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, tokens, domain, p_0, ..., rate)`` per row of ``docs(doc_id, text, ...)``; ``domain`` is the likeliest one.

    ``weights`` names the domains and their target shares; ``budget`` is the total of target tokens as a multiple of
    the tokens there are. Null and empty texts have no tokens: they hold no share and their rate follows the prior-free
    posteriors. Repeated rows get equal rates. With no labelled row all posteriors are alike. Domains that no document
    belongs to stay unmet. Extra columns are ignored, an empty table gives an empty result.
    """
    domains = sorted(weights)
    members = stored(posteriors(docs, domain_model(docs, labelled, domains, buckets, sample), domains, buckets), "members")
    tokens = float(members.agg(F.sum("tokens")).first()[0] or 0) * budget / (sum(weights.values()) or 1.0)
    return named(fitted_rates(members, [weights[d] * tokens for d in domains]), domains)


def named(rated: DataFrame, domains: list[str]) -> DataFrame:
    best = F.greatest(*[F.struct(F.col(f"p_{k}").alias("p"), F.lit(-k).alias("order"), F.lit(d).alias("domain")) for k, d in enumerate(domains)])
    return rated.select("doc_id", "tokens", best["domain"].alias("domain"), *[f"p_{k}" for k in range(len(domains))], "rate")


def tempered(docs: DataFrame, labelled: DataFrame, domains: list[str], power: float, buckets: int = BUCKETS, sample: int = SAMPLE) -> DataFrame:
    """As ``mixed``, with target shares in proportion to the natural ones raised to ``power`` and a budget at which
    the domain that is thinned most keeps its natural tokens: rare domains are repeated, none is cut."""
    domains = sorted(domains)
    members = stored(posteriors(docs, domain_model(docs, labelled, domains, buckets, sample), domains, buckets), "members")
    natural = [float(x or 0) for x in members.agg(*[F.sum(F.col("tokens") * F.col(f"p_{k}")) for k in range(len(domains))]).first()]
    raised = [n**power if n > 0 else 0.0 for n in natural]
    scale = max((n / r for n, r in zip(natural, raised) if r > 0), default=1.0)
    return named(fitted_rates(members, [r * scale for r in raised]), domains)


def repeated(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with each row repeated by its ``rate``: the whole part, and one more where a hash of the id falls below
    the rest. A document stays once at least; one without a rate stays once. Where ``rates`` repeats an id, its largest rate counts."""
    key, rate, copy = (free_name(docs, name) for name in ("key", "rate_of", "copy"))
    rates = rates.groupBy(F.col("doc_id").alias(key)).agg(F.max("rate").alias(rate))
    joined = docs.join(rates, docs["doc_id"].eqNullSafe(F.col(key)), "left")
    part = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.coalesce(rate, F.lit(1.0))
    times = F.greatest(F.lit(1), F.floor(wanted) + F.when(part < wanted - F.floor(wanted), 1).otherwise(0))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), times))).select(*docs.columns)
