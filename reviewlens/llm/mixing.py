"""Mixing sources to target weights, with soft membership. DataFrame functions only.

A classifier learned from a labelled table gives each document a posterior over domains. Rates r >= 0 of the documents
(how often each is to be read) are then fitted so that the expected tokens of every domain, sum over documents of
rate x tokens x posterior, match targets: projected gradient descent on the weighted squared error, starting from r = 1.
With document weights as the metric, a gradient step is a number per domain: r <- clip(r - posterior . step). Rates are
thus a function of the few steps so far, and an iteration is one sum over a narrow table (id, tokens, posterior).

The classifier is multinomial naive Bayes over words and punctuation runs: the ``FEATURES`` tokens that tell the domains
apart best, counted in at most ``MOST_LABELLED`` labelled documents (a documented bound, by least key hash). Its table
is broadcast: FEATURES rows. Posteriors, totals and rates cover all documents and whole texts.

Null and empty texts have no tokens, the prior as posterior, and a rate like others of that posterior. A document may
have a null id; repeated rows are documents of their own; labels of unknown documents and null labels are ignored; several
labels of one document: the least domain. With no labelled rows there is one domain, ``all``. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, share, stored

MOST_LABELLED, FEATURES, MOST_DOMAINS = 20_000, 4096, 64
#: Documents that a token has to occur in to be a feature.
LEAST_DOCUMENTS = 8
SMOOTHING = 0.5
STEPS, ENOUGH = 40, 1e-5
#: A row that every document has: it carries the prior.
_DOCUMENT = "\u0001"
#: Tokens end at white space and between a letter and punctuation.
_CUT = r"[\x09-\x0D\x20]+|(?<=\p{L})(?=[^\p{L}\x09-\x0D\x20])"


def tokens(text: Column) -> Column:
    """A text's words and punctuation runs, lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _CUT, -1), "")


def fit_classifier(df: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[list[str], DataFrame]:
    """(domains, table of token and its log probability in each domain) from ``labelled`` (doc_id, domain)."""
    spark = df.sparkSession
    one = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(F.min("domain").alias("domain"))
    docs = df.where(col(key).isNotNull()).select(col(key).alias("id"), col(text).alias("t"))
    rows = docs.join(one, F.col("id") == F.col("of"))
    sizes = {r["domain"]: r["n"] for r in docs.select("id").join(one, F.col("id") == F.col("of")).groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(MOST_DOMAINS + 1).collect()}
    if len(sizes) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    domains = list(sizes) or ["all"]
    total = sum(sizes.values())
    prior = [np.log(sizes.get(d, 1) / max(total, 1)) for d in domains]
    if total > MOST_LABELLED:
        rows = rows.where(share("id", "mix") < MOST_LABELLED / total)
    seen = rows.select("domain", F.explode(F.array_distinct(tokens(F.col("t")))).alias("token"))
    counts = seen.groupBy("token").agg(F.count("*").alias("n"), *(F.sum((F.col("domain") == d).cast("double")).alias(f"c{i}") for i, d in enumerate(domains)))
    counts = stored(counts.where(F.col("n") >= LEAST_DOCUMENTS), "mix-counts")
    all_ = counts.agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(len(domains)))).first()
    width = float(FEATURES)
    logs = [F.log((F.col(f"c{i}") + SMOOTHING) / ((all_[i] or 0.0) + SMOOTHING * width)) for i in range(len(domains))]
    # how far the domains disagree on a token, over the documents that have it
    spread = F.col("n") * (F.greatest(*logs, logs[0]) - F.least(*logs, logs[0]))
    best = counts.orderBy(F.desc(spread), "token").limit(FEATURES)
    model = best.select("token", *(x.alias(f"w{i}") for i, x in enumerate(logs)))
    mark = spark.range(1).select(F.lit(_DOCUMENT).alias("token"), *(F.lit(float(p)).alias(f"w{i}") for i, p in enumerate(prior)))
    return domains, stored(model.where(F.col("token") != _DOCUMENT).unionByName(mark).coalesce(1), "mix-model")


def posteriors(df: DataFrame, domains: list[str], model: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, n_tokens, p0, p1, ...) of every row of ``df``."""
    found = df.select(col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), tokens(col(text)).alias("t"))
    found = found.select("doc_id", "row", F.size("t").cast("long").alias("n_tokens"), F.explode(F.concat(F.array(F.lit(_DOCUMENT)), F.array_distinct("t"))).alias("word"))
    joined = found.join(F.broadcast(model), F.col("word") == F.col("token"))  # at most FEATURES + 1 rows
    names = [f"w{i}" for i in range(len(domains))]
    sums = joined.groupBy("doc_id", "row").agg(F.first("n_tokens").alias("n_tokens"), *(F.sum(w).alias(w) for w in names))
    top = F.greatest(*map(F.col, names)) if len(names) > 1 else F.col(names[0])
    shifted = sums.select("doc_id", "row", "n_tokens", *(F.exp(F.col(w) - top).alias(w) for w in names))
    whole = sum((F.col(w) for w in names[1:]), F.col(names[0]))
    return shifted.select("doc_id", "row", "n_tokens", *((F.col(w) / whole).alias(f"p{i}") for i, w in enumerate(names)))


def rate_of(steps: list[np.ndarray], least: float, most: float) -> Column:
    """Rates after the given steps."""
    r = F.lit(1.0)
    for step in steps:
        move = sum((F.col(f"p{i}") * float(x) for i, x in enumerate(step)), F.lit(0.0))
        r = F.least(F.greatest(r - move, F.lit(least)), F.lit(most))
    return r


def fit_rates(table: DataFrame, targets: np.ndarray, least: float = 0.0, most: float = 16.0) -> tuple[list[np.ndarray], np.ndarray]:
    """(steps, expected tokens by domain) for ``posteriors`` rows and target tokens by domain."""
    d, p, n = len(targets), [F.col(f"p{i}") for i in range(len(targets))], F.col("n_tokens")
    gram = table.agg(*(F.sum(n * p[i] * p[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(d))).first()
    h = np.array([x or 0.0 for x in gram]).reshape(d, d)
    # the error is weighted by the inverse of this matrix: its gradient then has the Lipschitz constant 1
    weight = np.linalg.inv(h + np.eye(d) * (1e-6 * np.trace(h) / d + 1e-9))
    steps: list[np.ndarray] = []
    last = np.full(d, np.inf)
    while True:
        rate = rate_of(steps, least, most)
        totals = np.array([x or 0.0 for x in table.agg(*(F.sum(rate * n * p[i]).alias(f"t{i}") for i in range(d))).first()])
        error = totals - targets
        enough = ENOUGH * max(targets.sum(), 1.0)
        # met, or at the limits of the rates: the totals no longer move
        if len(steps) >= STEPS or np.abs(error).sum() <= enough or np.abs(totals - last).sum() <= enough:
            return steps, totals
        last = totals
        steps.append(weight @ error)


def mix(df: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, least: float = 0.0,
        most: float = 16.0, key: str = "doc_id", text: str = "text") -> tuple[list[str], DataFrame]:
    """(domains, table of doc_id, row, n_tokens, p0, ..., rate). ``weights``: target share of each domain (a domain left
    out: 0); without it, the present shares to the power ``temper``. The targets add up to the present tokens, or where
    rates have a least value, to as many as keep every domain's target above what the least rates give it."""
    domains, model = fit_classifier(df, labelled, key, text)
    table = stored(posteriors(df, domains, model, key, text), "mix-posteriors")
    now = np.array([x or 0.0 for x in table.agg(*(F.sum(F.col("n_tokens") * F.col(f"p{i}")).alias(f"t{i}") for i in range(len(domains)))).first()])
    wanted = np.array([weights.get(d, 0.0) for d in domains]) if weights is not None else now**temper
    wanted = wanted / wanted.sum() if wanted.sum() > 0 else np.full(len(domains), 1 / len(domains))
    total = now.sum()
    if least > 0:
        total = max(total, max((least * t / w for t, w in zip(now, wanted) if w > 0), default=total))
    steps, _ = fit_rates(table, wanted * total, least, most)
    # the steps are a few numbers: rates of a plan this deep are computed once
    return domains, stored(table.withColumn("rate", rate_of(steps, least, most)), "mix-rates")


def report(domains: list[str], mixed: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate): the likeliest domain, all posteriors as a map, and the rate."""
    names = F.array(*map(F.lit, domains))
    ps = F.array(*(F.col(f"p{i}") for i in range(len(domains))))
    best = F.get(names, (F.array_position(ps, F.array_max(ps)) - 1).cast("int"))
    return mixed.select("doc_id", "n_tokens", best.alias("domain"), F.map_from_arrays(names, ps).alias("posterior"), F.round("rate", 6).alias("rate"))


def repeat(df: DataFrame, labelled: DataFrame, temper: float = 0.8, most: float = 3.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with each row as often as its fitted rate says, once at least: the rate's whole part, and once more
    with the probability of the rest, decided by a hash of the id. No row is lost."""
    times, of, copy = fresh(df, "_times", "_of", "_copy")
    _, mixed = mix(df, labelled, None, temper, 1.0, most, key, text)
    counts = mixed.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(of)).agg(F.max("rate").alias(times))
    more = counts.withColumn(times, F.floor(col(times) + share(of, "copies")).cast("int")).where(col(times) > 1)
    joined = df.join(more, col(key) == col(of), "left")
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.coalesce(col(times), F.lit(1))))).select(*map(col, df.columns))
