"""Document rates that bring soft domain memberships to target token totals."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.llm.common import arrow_rows, bounded_sample, empty_if_null, staged

#: Labelled rows of each domain that the classifier is fitted on at most, the first by a hash of the id.
FIT_ROWS = 3000
FEATURES = 1 << 14
#: Rounds after which a fit is given up with an error (it needs about 10), and the largest miss of a total.
ITERATIONS = 400
TOLERANCE = 1e-4
#: Pulls of the rates towards one, and lengths of a Newton step.
PULLS = tuple(10.0**-i for i in range(3, 10))
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001, 0.0001)
#: Targets are no less than this many times what lower bounds force: nearer, a few documents would be taken very often.
ROOM = 1.2


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "plain")


def fit_posteriors(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], PipelineModel | None]:
    """Domains (sorted) and a classifier of their posteriors, from ``labels`` (``doc_id, domain``).

    The sample has at most ``fit_rows`` rows of a domain and is broadcast, so the documents it
    names are picked where they are read. Labels that are null are left out; a document with
    several labels counts once, with the first by name.
    """
    single = labels.filter("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = staged(bounded_sample(single, "domain", fit_rows))
    domains = sorted(r["domain"] for r in sample.select("domain").distinct().collect())
    at = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(float(i)))]) if domains else None
    if not domains:
        return domains, None
    learn = staged(
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", at[F.col("domain")].alias("label"))
    )
    if len(domains) < 2 or learn.select("label").distinct().count() < len(domains):
        return domains, None
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+", toLowercase=True)
    counts = HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES, binary=True)
    model = LogisticRegression(maxIter=30, regParam=0.02, family="multinomial", standardization=False)
    return domains, Pipeline(stages=[words, counts, model]).fit(learn)


def posteriors(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], DataFrame]:
    """Domains, and ``doc_id, n_tokens, posterior`` of every document (tokens: runs of non-blanks).

    Where nothing can be told apart (no labels, one domain, or no labelled documents) all domains are equally likely.
    """
    plain = docs.select("doc_id", empty_if_null(F.col("text")).alias("text"))
    domains, model = fit_posteriors(plain, labels, fit_rows)
    tokens = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("n_tokens")
    if model is None:
        share = F.array(*[F.lit(1.0 / len(domains))] * len(domains)) if domains else F.array().cast("array<double>")
        return domains, staged(plain.select("doc_id", tokens, share.alias("posterior")))
    scored = model.transform(plain)
    return domains, staged(scored.select("doc_id", F.size("words").cast("long").alias("n_tokens"), vector_to_array("probability").alias("posterior")))


def bounds(p: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The lower bound of each document's rate: that of its likeliest domain."""
    return least[p.argmax(axis=1)] if p.shape[1] else np.zeros(len(p))


def rates_of(p: np.ndarray, slopes: np.ndarray, lower: np.ndarray | float = 0.0) -> np.ndarray:
    """Rates of documents with posteriors ``p``."""
    return np.maximum(lower, 1.0 + p @ slopes)


def moments(
    rows: DataFrame, tries: Sequence[np.ndarray], least: np.ndarray, corpus: float
) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each vector of slopes, over all tokens of the corpus: the dual's value without its linear part, the
    expected shares of the domains, and the domains' second moments where rates are above their bounds.
    One pass; 1 + k + k x k numbers a try reach the driver."""
    k = len(least)

    def part(batch: pa.RecordBatch) -> dict[str, list]:
        tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(float) / corpus
        p = batch.column(1).flatten().to_numpy().reshape(len(tokens), k)
        lower = bounds(p, least)
        out = []
        for slopes in tries:
            rate = rates_of(p, slopes, lower)
            free = tokens * (rate > lower)
            out += [[(tokens * (rate * (1.0 + p @ slopes) - rate**2 / 2)).sum()], (rate * tokens) @ p, ((p * free[:, None]).T @ p).ravel()]
        return {"v": [np.concatenate(out)]}

    width = 1 + k + k * k
    found = arrow_rows(rows.select("n_tokens", "posterior"), part, "v array<double>")
    sums = found.agg(*[F.sum(F.col("v")[i]) for i in range(len(tries) * width)]).first()
    out = np.array([x or 0.0 for x in sums]).reshape(len(tries), width)
    return [(float(x[0]), x[1 : 1 + k], x[1 + k :].reshape(k, k)) for x in out]


def forced(rows: DataFrame, least: np.ndarray, corpus: float) -> np.ndarray:
    """The expected totals of the domains that the lower bounds alone come to, as shares of the corpus."""
    return moments(rows, [np.full(len(least), -1e12)], least, corpus)[0][1]


def fit_rates(
    rows: DataFrame, targets: np.ndarray, least: np.ndarray | None = None, iterations: int = ITERATIONS, tolerance: float = TOLERANCE
) -> np.ndarray:
    """Slopes of the rates, not below their bounds, whose expected totals come nearest to ``targets``.

    Minimised is the squared distance of the totals (as shares of the corpus) plus a small pull of the
    rates towards one. The rates of its solution are ``max(bound, 1 + posterior . slopes)``, with one slope for
    each domain (``least`` bounds rates by likeliest domain, 0 without); the slopes solve the convex dual problem, by Newton steps with a line search. A round is one pass
    that returns the domains' totals and second moments. The pull is lowered, tenfold at a time, until the
    totals are within ``tolerance`` of the targets, or is so small that no nonnegative rates can come
    noticeably nearer; then a warning names what is missing. A fit that needs over
    ``iterations`` rounds is an error, never a silent result.
    """
    k = len(targets)
    least = np.zeros(k) if least is None else np.asarray(least, dtype=float)
    corpus = float(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    slopes = np.zeros(k)
    if not k or corpus <= 0:
        return slopes
    share = np.asarray(targets, dtype=float) / corpus
    tolerance *= max(1 / corpus, share.sum())
    (now,), rounds = moments(rows, [slopes], least, corpus), 1
    for pull in PULLS:
        while True:
            energy, reached, curve = now
            lack = reached + pull * slopes - share
            if np.abs(reached - share).max() <= tolerance:
                return slopes
            if np.abs(lack).max() <= tolerance / 1000:
                break
            move = -np.linalg.solve(curve + pull * np.eye(k), lack)
            value = energy + pull / 2 * slopes @ slopes - slopes @ share
            found = None
            for sizes in (STEPS[:1], STEPS[1:]):
                if rounds >= iterations:
                    raise RuntimeError(f"rates not fitted after {rounds} rounds: shares {reached}, targets {share}")
                tries = [slopes + size * move for size in sizes]
                seen, rounds = moments(rows, tries, least, corpus), rounds + 1
                values = [e + pull / 2 * t @ t - t @ share for t, (e, _, _) in zip(tries, seen)]
                best = int(np.argmin(values))
                if values[best] < value + 1e-4 * sizes[best] * (lack @ move):
                    found = tries[best], seen[best]
                    break
            if found is None:  # as near as rounding lets it come
                break
            slopes, now = found
    if np.abs(lack).max() > tolerance:
        raise RuntimeError(f"rates not fitted after {rounds} rounds: shares {reached}, targets {share}")
    warnings.warn(f"no rates meet the targets: shares of the corpus {reached.tolist()}, targets {share.tolist()}", stacklevel=2)
    return slopes


def mix(
    df: DataFrame, labels: DataFrame, weights: dict[str, float], scale: float = 1.0, fit_rows: int = FIT_ROWS,
    least: dict[str, float] | None = None,
) -> DataFrame:
    """``doc_id, n_tokens, domain, posterior, rate, copies`` for every document.

    ``labels`` has ``doc_id, domain``; ``weights`` gives the share of each domain in ``scale``
    times the corpus' tokens (a domain that is not named gets none). ``rate`` is how often the
    document is to be taken on average, ``copies`` a whole number with that mean: the rate is
    rounded down or up by a hash of the id. ``domain`` is the likeliest, the first by
    name among equal ones; ``posterior`` follows the sorted names.

    ``least`` bounds the rates of documents by their likeliest domain from below: with 1 they stay once at
    least. The bounds are part of the fit, so the totals of the output still meet the targets. A target below ``ROOM`` times what
    the bounds force on a domain is raised to that. Shares are expected ones, by the classifier's
    posteriors, not by labels. Where no rates meet the targets, the nearest totals are taken and a warning gives them.

    A null or empty text has no tokens and any rate suits it. With no labels there are no
    domains: rates are one and ``domain`` is null. Ids may repeat or be null; further columns are
    ignored; an empty table gives an empty result.
    """
    domains, found = posteriors(df, labels, fit_rows)
    corpus = float(found.agg(F.sum("n_tokens")).first()[0] or 0)
    share = np.array([weights.get(d, 0.0) for d in domains])
    share = share / share.sum() if share.sum() > 0 else share
    lower = np.array([(least or {}).get(d, 0.0) for d in domains])
    targets = scale * share
    if lower.any() and corpus:
        targets = np.maximum(targets, ROOM * forced(found, lower, corpus))
    slopes = fit_rates(found, targets * corpus, lower)
    k = len(domains)

    def rated(batch: pa.RecordBatch) -> dict[str, list]:
        p = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, k)
        best = p.argmax(axis=1).tolist() if k else []
        return {
            "doc_id": batch.column(0),
            "n_tokens": batch.column(1),
            "domain": [domains[i] for i in best] if k else [None] * batch.num_rows,
            "posterior": batch.column(2),
            "rate": rates_of(p, slopes, bounds(p, lower)),
        }

    rates = arrow_rows(
        found.select(F.col("doc_id").cast("long"), "n_tokens", "posterior"), rated,
        "doc_id long, n_tokens long, domain string, posterior array<double>, rate double",
    )
    chance = (F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 20)) + 0.5) / (1 << 20)
    return rates.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))
