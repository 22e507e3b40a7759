"""Two-layer decisions, model comparison and counterfactual swaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions import stats
from sentrylens.operators import thresholds as T
from sentrylens.operators.audit import class_medians
from sentrylens.operators.splits import fit_scaler, scaled
from sentrylens.session import staged


def distance_score(columns: Sequence[str], scaler: dict) -> Column:
    """MOD2: sum of squared standardised features; higher is more anomalous.

    The linear-time stand-in for kernel one-class models; fit the scaler on benign rows.
    """
    return reduce(lambda a, b: a + b, [z * z for z in scaled(columns, scaler).values()])


def fit_distance(benign: DataFrame, columns: Sequence[str]) -> dict:
    """MOD2: the benign model, i.e. its scaler."""
    return fit_scaler(benign, columns)


def fit_array_distance(benign: DataFrame, column: str) -> list[tuple[float, float]]:
    """MOD2 over an array column: mean and population deviation of every position.

    As many positions as the longest array has; two numbers for each reach the driver.
    """
    rows = (
        benign.select(F.posexplode(column).alias("i", "v"))
        .groupBy("i")
        .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
        .collect()
    )
    found = {r["i"]: (r["m"] or 0.0, r["d"] or 1.0) for r in rows}
    return [found[i] for i in range(len(found))]


def array_distance_score(column: str, model: Sequence[tuple[float, float]]) -> Column:
    """MOD2 over an array column; a null or missing position stands at its mean."""
    zero = F.lit(0.0)
    parts = [
        F.coalesce(F.pow((F.get(column, F.lit(i)).cast("double") - m) / d, F.lit(2.0)), zero)
        for i, (m, d) in enumerate(model)
    ]
    return F.aggregate(F.array(*parts), zero, lambda a, b: a + b) if parts else zero


def defers(rule: Column, criticality: Column, rules: Sequence[str] = C.DEFERRED_RULES) -> Column:
    """MOD8: the known-attack layer is ignored for these rules on low-value agents."""
    return F.coalesce(rule.isin(*rules) & (criticality == 1), F.lit(False))


def two_layer(
    s1: Column, s2: Column, theta1: float, theta2: float, deferred: Column | None = None
) -> dict[str, Column]:
    """MOD7, MOD8: forward known attacks, mark zero-day candidates, suppress the rest."""
    first = s1 >= theta1
    if deferred is not None:
        first = first & ~deferred
    second = s2 >= theta2

    def case(a: str, b: str, c: str) -> Column:
        return F.when(first, a).when(second, b).otherwise(c)

    return {
        "decision": case("forward", "suspicious", "suppress"),
        "category": case("known_attack", "zero_day_candidate", "benign"),
        "layer": case("l1", "l2", "none"),
    }


def raw_combination(hit1: Column, hit2: Column) -> Column:
    """MOD9: attack if either layer says so."""
    return (hit1 | hit2).cast("int")


def layer_value(df: DataFrame, hit1: str, hit2: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """MOD9: what the first layer adds to the second (percentage points), with a verdict."""
    attack, benign = F.col(y) == 1, F.col(y) == 0
    second = F.col(hit2) == 1
    both = raw_combination(F.col(hit1) == 1, second) == 1
    out = (
        df.groupBy(*by)
        .agg(
            F.count_if(attack).alias("_a"),
            F.count_if(benign).alias("_b"),
            *[F.count_if(of & hit).alias(n) for of, hit, n in (
                (attack, both, "_a12"), (attack, second, "_a2"), (benign, both, "_b12"), (benign, second, "_b2"))],
        )
        .select(
            *by,
            (100 * (stats.ratio(F.col("_a12"), F.col("_a")) - stats.ratio(F.col("_a2"), F.col("_a")))).alias("recall_pp"),
            (100 * (stats.ratio(F.col("_b12"), F.col("_b")) - stats.ratio(F.col("_b2"), F.col("_b")))).alias("fpr_pp"),
        )
    )
    return out.withColumn(
        "verdict",
        F.when((F.col("recall_pp") <= 1) & (F.col("fpr_pp") > 1), "more false alarms only")
        .when(F.col("recall_pp") > 1, "more recall")
        .otherwise("about equal"),
    )


def routed(
    platform: Column, routes: Mapping[str, tuple[bool, float, float]], s1: Column, s2: Column
) -> Column:
    """MOD10: per-platform pipeline: (use first layer, theta1, theta2)."""
    call = None
    for name, (use_first, t1, t2) in routes.items():
        hit = (s1 >= t1) | (s2 >= t2) if use_first else (s2 >= t2)
        call = F.when(platform == name, hit) if call is None else call.when(platform == name, hit)
    return F.coalesce(call, F.lit(False)).cast("int")


def model_matrix(scores: DataFrame, y: str = "y") -> DataFrame:
    """MOD11: recall at 10 % and 5 % FPR, best F1 and separation per model.

    ``scores`` is long: model, y, score. All models share one pass.
    """
    from sentrylens.operators.audit import separation

    scores = staged(scores)
    curve = staged(T.score_curve(scores, "score", y, ["model"]))
    at10 = T.recall_at_fpr(curve, 0.10, ["model"]).select(
        "model", F.col("recall").alias("recall_at_10pct"), F.col("threshold").alias("threshold_10pct")
    )
    at5 = T.recall_at_fpr(curve, 0.05, ["model"]).select("model", F.col("recall").alias("recall_at_5pct"))
    f1 = T.max_f1(curve, ["model"]).select("model", F.col("f1").alias("best_f1"))
    sep = separation(scores, "score", y, ["model"]).select(
        "model", "attack_median", "benign_median", "separation"
    )
    return at10.join(at5, "model").join(f1, "model").join(sep, "model")


def recall_per_technique(scores: DataFrame, matrix: DataFrame, technique: str, y: str = "y") -> DataFrame:
    """MOD11: recall per model and technique at the model's 10 % threshold."""
    attacks = scores.filter(F.col(y) == 1).join(matrix.select("model", "threshold_10pct"), "model")
    n = F.count(F.lit(1))
    return attacks.groupBy("model", technique).agg(
        n.alias("n"), (F.count_if(F.col("score") >= F.col("threshold_10pct")) / n).alias("recall")
    )


def outcome(
    matrix: DataFrame, per_technique: DataFrame, technique: str, reference: str,
    quiet: float = 0.5, min_n: int = 3, margin: float = 0.20, fail: float = 0.30,
) -> DataFrame:
    """MOD12: A if swapping the model helps, B if every model fails, else C."""
    ref = F.col("model") == reference
    wide = per_technique.groupBy(technique).agg(
        F.max("n").alias("n"),
        F.max(F.when(ref, F.col("recall"))).alias("ref"),
        F.max(F.when(~ref, F.col("recall"))).alias("alt"),
    )
    is_quiet = (F.col("ref") < quiet) & (F.col("n") >= min_n)
    counts = wide.agg(
        F.count_if(is_quiet).alias("n_quiet"),
        F.count_if(is_quiet & (F.col("alt") - F.col("ref") > margin)).alias("n_wins"),
        F.count_if(is_quiet & (F.greatest("ref", "alt") < fail)).alias("n_all_fail"),
    ).withColumn("_k", F.lit(1))
    gain = matrix.agg(
        (
            F.max(F.when(~ref, F.col("recall_at_10pct"))) - F.max(F.when(ref, F.col("recall_at_10pct")))
        ).alias("gain")
    ).withColumn("_k", F.lit(1))
    return counts.join(gain, "_k").drop("_k").withColumn(
        "outcome",
        F.when((F.col("n_wins") > 0) & (F.col("gain") > margin), "A")
        .when((F.col("n_all_fail") > 0) & (F.col("n_wins") == 0), "B")
        .otherwise("C"),
    )


def saturation(df: DataFrame, pred: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """MOD13: a layer that calls more than half of the benign rows is saturated."""
    benign = df.filter(F.col(y) == 0)
    share = stats.ratio(F.count_if(F.col(pred) == 1), F.count(F.lit(1)))
    return benign.groupBy(*by).agg(share.alias("benign_hit_share")).withColumn(
        "saturated", F.col("benign_hit_share") > 0.5
    )


def tradeoff(
    gains: DataFrame, regressions: DataFrame, key: str, reference: str, flag_pp: float = 3.0
) -> DataFrame:
    """JN16: per candidate the gain on one platform against the change on the other.

    ``regressions`` holds the reference row under ``reference``; changes are in
    percentage points against it.
    """
    ref = regressions.filter(F.col(key) == reference)
    base = {c: ref.select(c).scalar() for c in ("recall", "fpr", "f1")}
    both = gains.select(key, F.col("f1").alias("gain_f1"), F.col("fpr").alias("gain_fpr")).join(
        regressions.filter(F.col(key) != reference), key
    )
    delta = both.select(
        key,
        "gain_f1",
        "gain_fpr",
        (100 * (F.col("recall") - base["recall"])).alias("recall_delta_pp"),
        (100 * (F.col("fpr") - base["fpr"])).alias("fpr_delta_pp"),
        (F.col("f1") - base["f1"]).alias("f1_delta"),
    )
    return delta.withColumn(
        "flag",
        F.when(F.col("recall_delta_pp") < -flag_pp, "worse")
        .when(F.col("recall_delta_pp") > flag_pp, "better")
        .otherwise("about equal"),
    )


# --- counterfactuals --------------------------------------------------------------------------


def medians_of(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Medians of a column block, one number per feature."""
    return {r["feature"]: r["median"] for r in class_medians(df, columns, []).collect()}


def swapped(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """CFX1, CFX3, CFX5: the same rows with a column block set to fixed values."""
    return df.withColumns({c: F.lit(float(v)) for c, v in values.items()})


def null_values(columns: Sequence[str]) -> dict[str, float]:
    """CFX2: the null value of each column: 0, or 999 for the time since a high alert."""
    return {c: C.NO_RECENT_HIGH if c == "time_since_last_high" else 0.0 for c in columns}


def zeroed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CFX2: a column block at its null values."""
    return swapped(df, null_values(columns))


def swap_recalls(
    df: DataFrame, variants: Mapping[str, Mapping[str, float]], columns: Sequence[str], scaler: dict,
    theta: float, by: Sequence[str] = (),
) -> DataFrame:
    """CFX1-CFX5: hit rate of the distance score, original and under each swap.

    All variants are scored side by side in one pass over the rows.
    """

    def hit(values: Mapping[str, float]) -> Column:
        parts = []
        for c in columns:
            median, mean, sd = scaler[c]
            v = F.lit(float(values[c])) if c in values else F.coalesce(F.col(c).cast("double"), F.lit(median))
            z = (v - mean) / (sd if sd else 1.0)
            parts.append(z * z)
        return reduce(lambda a, b: a + b, parts) >= theta

    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("n"),
        F.count_if(hit({})).alias("hits_original"),
        *[F.count_if(hit(v)).alias(f"hits_{name}") for name, v in variants.items()],
    )


def block_chain(medians: Mapping[str, float], blocks: Sequence[tuple[str, Sequence[str]]]) -> dict:
    """CFX4: cumulative swaps: first block, first two blocks, and so on."""
    chain, taken = {}, {}
    for name, columns in blocks:
        taken = {**taken, **{c: medians[c] for c in columns if c in medians}}
        chain[name] = dict(taken)
    return chain
