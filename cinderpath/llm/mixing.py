"""Mixing sources to target weights, with DataFrame functions only.

A naive Bayes classifier, learned from the labelled table, gives each document a posterior over domains.
Each document then gets a nonnegative rate, by projected gradient descent, such that the expected tokens of
the domains meet their targets while rates stay near one.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save, tune

#: Buckets of hashed words, and words after which evidence from a document doesn't grow: posteriors stay soft.
BUCKETS, EVIDENCE = 2048, 20
#: The classifier is fitted on so many labelled documents, and so many of each domain at least, picked by a hash of the id;
#: on all of them if there are fewer. Their ids (under a megabyte, and 8 kB a domain) are broadcast, so that no text is
#: shuffled; domains, priors, scoring and all sums cover every document.
SAMPLE, EACH = 50_000, 1000
#: balance() goes on until each domain's share is so near its target, relatively and absolutely, for so many steps at most;
#: rates are written every so many; a step halved below this length ends it.
NEAR, LEAST, MANY, WRITTEN, SHORTEST = 1e-3, 1e-5, 100, 6, 1e-4
OTHER = "other"


def _tokens(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\u000B\\f\\r]+"), lambda w: w != "")


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _total(columns: list):
    """Their sum, as a balanced tree: hundreds of columns don't nest deeply."""
    if len(columns) < 2:
        return columns[0] if columns else F.lit(0.0)
    half = len(columns) // 2
    return _total(columns[:half]) + _total(columns[half:])


def classifier(documents: DataFrame, labels: DataFrame, domain_col: str) -> tuple[list[str], DataFrame, list[float]]:
    """All labelled domains, log-probabilities (bucket, l0, l1, ...) of words, and the domains' log-priors; words come from a bounded sample."""
    import math

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(domain_col).cast("string"), F.lit(OTHER)).alias("domain"), F.col("text").cast("string").alias("text"))
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    named = save(own.where("doc_id is not null").select("doc_id", "domain").join(ids, "doc_id", "left_semi"))
    counted = save(named.groupBy("domain").agg(F.count("*").alias("n_domain")))
    prior = {r["domain"]: r["n_domain"] for r in counted.orderBy(F.desc("n_domain"), "domain").collect()} or {OTHER: 0}
    domains, n = list(prior), max(1, sum(prior.values()))
    priors = [math.log((prior[d] + 1) / (n + len(domains))) for d in domains]
    chance = F.greatest(F.lit(SAMPLE / n), F.lit(float(EACH)) / F.col("n_domain"))
    known = named.join(F.broadcast(counted), "domain").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < chance * (1 << 30)).select("doc_id").distinct()
    learn = own.join(F.broadcast(save(known)), "doc_id", "left_semi")
    words = learn.select("domain", F.explode(_tokens(F.col("text"))).alias("w"))
    counts = save(words.groupBy("domain", _bucket(F.col("w")).alias("bucket")).count())
    every = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("count").alias("n")).collect()}
    base = documents.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    columns = []
    for i, d in enumerate(domains):
        n = F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("count"))), F.lit(0))
        columns.append(F.log((n + 1.0) / float(every.get(d, 0) + BUCKETS)).alias(f"l{i}"))
    table = save(base.join(counts, "bucket", "left").groupBy("bucket").agg(*columns).coalesce(1))
    return domains, table, priors


def posteriors(documents: DataFrame, labels: DataFrame, domain_col: str = "source") -> tuple[list[str], DataFrame]:
    """Domains, and doc_id, n_tokens, p0, p1, ... for every document that has an id."""
    domains, table, priors = classifier(documents, labels, domain_col)
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer(_tokens(F.col("text").cast("string"))).alias("w"))
    # BUCKETS rows of a number for each domain: 16 kB a domain, whatever the corpus.
    words = docs.select("doc_id", _bucket(F.coalesce("w", F.lit(""))).alias("bucket"), F.col("w").isNotNull().cast("long").alias("one")).join(F.broadcast(table), "bucket")
    sums = words.groupBy("doc_id").agg(F.sum("one").alias("n_tokens"), *(F.sum(F.col(f"l{i}") * F.col("one")).alias(f"s{i}") for i in range(len(domains))))
    soft = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.col("n_tokens"), F.lit(1)))
    scores = sums.select("doc_id", "n_tokens", *(((F.col(f"s{i}") * soft) + priors[i]).alias(f"s{i}") for i in range(len(domains))))
    top = F.greatest(*(F.col(f"s{i}") for i in range(len(domains)))) if len(domains) > 1 else F.col("s0")
    shifted = scores.select("doc_id", "n_tokens", *(F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in range(len(domains))))
    whole = _total([F.col(f"e{i}") for i in range(len(domains))])
    return domains, save(shifted.select("doc_id", "n_tokens", *((F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(len(domains)))))


def _moved(rate, parts, move: np.ndarray):
    """Rates after a step of projected gradient: each goes by its posteriors' product with the move, and not below zero."""
    return F.greatest(F.lit(0.0), rate + _total([parts[i] * float(move[i]) for i in range(len(move))]))


def _moments(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (n_tokens, p0, ..., rate): the domains' expected tokens, and the second moments of the posteriors of tokens with a rate above zero.

    One aggregation to k rows; a row for each domain lets hundreds of domains be k columns, not k squared.
    """
    each = rows.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"p{i}").alias("p")) for i in range(k)))).alias("d"))
    tokens = F.col("n_tokens") * F.col("d.p")
    live = F.when(F.col("rate") > 0, tokens).otherwise(0.0)
    got = each.groupBy("d.i").agg(F.sum(tokens * F.col("rate")).alias("s"), *(F.sum(live * F.col(f"p{j}")).alias(f"m{j}") for j in range(k))).collect()
    sums, second = np.zeros(k), np.zeros((k, k))
    for r in got:
        sums[r["i"]], second[r["i"]] = r["s"], [r[f"m{j}"] for j in range(k)]
    return sums, second


def balance(table: DataFrame, k: int, targets: list[float] | None = None) -> DataFrame:
    """doc_id, n_tokens, rate: nonnegative rates whose expected tokens meet the domains' targets, by distributed projected-gradient least squares.

    Over (doc_id, n_tokens, p0, ...). From rates of one, each step takes the squared distance of the domains' shares from
    the targets down its gradient over the documents' rates, which is the posteriors' product with the k errors, and
    projects at zero. The errors are scaled by the inverse second moments of the posteriors where rates aren't zero: with
    no rate at zero one step ends it, with the rates nearest to one. A step that doesn't bring the shares nearer is halved.
    It ends with each share within NEAR of its target plus LEAST; targets out of reach end where no step helps, with a
    warning. A step is one aggregation; every WRITTEN steps the rates are written, so that plans stay short.
    """
    state = table.withColumn("rate", F.lit(1.0))
    parts = [F.col(f"p{i}") for i in range(k)]
    sums, second = _moments(state, k)
    n = float(sums.sum())  # the posteriors of a document sum to one
    if not n:
        return state.select("doc_id", "n_tokens", "rate")
    share = sums / n
    aim = share**0.7 / (share**0.7).sum() if targets is None else np.array(targets, float)
    near = NEAR * aim + LEAST
    error, steps = share - aim, 0
    written = None
    while (np.abs(error) > near).any() and steps < MANY:
        move, length = -np.linalg.pinv(second / n, rcond=1e-10, hermitian=True) @ error, 1.0
        while True:
            steps += 1
            tried = state.withColumn("rate", _moved(F.col("rate"), parts, length * move))
            sums, second_ = _moments(tried, k)
            if (((sums / n - aim) / near) ** 2).sum() < ((error / near) ** 2).sum() or length < SHORTEST:
                break
            length /= 2
        if length < SHORTEST:
            break
        state, second, error = tried, second_, sums / n - aim
        if steps % WRITTEN == 0:
            last, written = written, save(state)
            state = written
            if last is not None:
                drop(table.sparkSession, last)
    if (np.abs(error) > near).any():
        worst = int(np.argmax(np.abs(error) / near))
        warnings.warn(f"mixing: targets out of reach of the posteriors; domain {worst} has {error[worst] + aim[worst]:.6f} of the tokens, not {aim[worst]:.6f}", stacklevel=2)
    return state.select("doc_id", "n_tokens", "rate")


def mix(documents: DataFrame, labels: DataFrame, domain_col: str = "source", weights: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """doc_id, n_tokens, rate, copies of every document that has an id.

    weights give the domains' target shares (those not named have 0; one of no labelled domain is an error); without
    them, the corpus's own shares to the power 0.7 are the targets. copies is the rate, rounded up or down by a hash of
    the id so that it holds on average. Null domains count as "other". Null and empty texts
    have no tokens and the posterior of the priors; repeated ids count as one document. Without labelled documents
    there is one domain and all rates are one. Other columns are ignored. An empty table gives an empty result.
    """
    tune(documents.sparkSession)
    domains, table = posteriors(documents, labels, domain_col)
    targets = None
    if weights:
        whole = sum(weights.values())
        if unknown := sorted(set(weights) - set(domains)):
            raise ValueError(f"weights of domains without labelled documents: {unknown}")
        if min(weights.values()) < 0 or not whole > 0:
            raise ValueError("weights must not be negative, and one must be positive")
        targets = [weights.get(d, 0.0) / whole for d in domains]
    out = balance(table, len(domains), targets)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    base = F.floor("rate")
    return out.select("doc_id", "n_tokens", "rate", (base + (chance < F.col("rate") - base).cast("long")).cast("int").alias("copies"))


def mixed_documents(documents: DataFrame, mixture: DataFrame) -> DataFrame:
    """The documents, each as often as its copies say; documents without an id stay once.

    The mixture has a row for each document, so it is never broadcast: both sides are shuffled at every size.
    """
    copies = mixture.select(F.col("doc_id").alias("id"), "copies").hint("merge")
    # The document is one column, so that its columns' names, whatever they are, meet no others.
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    rows = rows.join(copies, F.col("row.doc_id") == F.col("id"), "left")
    times = F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))
    return rows.where(F.coalesce("copies", F.lit(1)) > 0).select("row", F.explode(times)).select("row.*")
