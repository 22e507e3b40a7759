"""Audit tables: is a detection score real or a property of the labels?

Every function is one grouped job (or a few over already reduced tables). Tables that
grow with the data are never gathered: totals are scalar subqueries or joins on the
group, order statistics come from ``ordered.ranked_counts``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions import stats
from sentrylens.functions.flags import is_mapped
from sentrylens.operators.ordered import (
    Running,
    exact_quantiles,
    ranked_counts,
    running,
    upper_median,
)
from sentrylens.session import staged


def _n() -> Column:
    return F.count(F.lit(1))


def _attacks(y: str) -> Column:
    return F.sum(F.col(y).cast("long"))


# --- lookup tables and confusion matrices ----------------------------------------------


def fit_lookup(train: DataFrame, sig: str, y: str = "y") -> DataFrame:
    """AGG1: majority label per signature, ties to attack."""
    return train.groupBy(sig).agg(_attacks(y).alias("n_attack"), _n().alias("n")).select(
        sig,
        "n",
        "n_attack",
        (F.col("n") - F.col("n_attack")).alias("n_benign"),
        (2 * F.col("n_attack") >= F.col("n")).cast("int").alias("majority"),
    )


def apply_lookup(df: DataFrame, table: DataFrame, sig: str, out: str = "pred") -> DataFrame:
    """JN11: attach the majority label; unseen signatures are benign.

    The table is left to the adaptive planner: broadcast when it turns out small, a
    sort-merge join with skew splitting when not.
    """
    return df.join(table.select(sig, F.col("majority").alias(out)), sig, "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(0))
    )


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """AGG2, AGG3: confusion matrix and rates per group."""
    actual, called = F.col(y) == 1, F.col(pred) == 1
    cells = df.groupBy(*by).agg(
        F.count_if(actual & called).alias("tp"),
        F.count_if(~actual & called).alias("fp"),
        F.count_if(~actual & ~called).alias("tn"),
        F.count_if(actual & ~called).alias("fn"),
    )
    return cells.withColumns(stats.rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def trivial_baseline(df: DataFrame, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """AGG4: scores of the detector that always says attack."""
    base = df.groupBy(*by).agg(_n().alias("n"), _attacks(y).alias("n_attack"))
    p = stats.ratio(F.col("n_attack"), F.col("n"))
    return base.withColumns(
        {
            "trivial_precision": p,
            "trivial_recall": F.when(F.col("n_attack") > 0, 1.0).otherwise(0.0),
            "trivial_f1": F.coalesce(2 * p / (1 + p), F.lit(0.0)),
        }
    )


def lookup_vs_trivial(
    train: DataFrame, test: DataFrame, sig: str, y: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """The headline audit: does a per-signature lookup beat always-attack?"""
    scored = apply_lookup(test, fit_lookup(train, sig, y), sig)
    cells = confusion(scored, y, "pred", by)
    n_attack, n = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    p = stats.ratio(n_attack, n)
    return cells.withColumn("trivial_f1", F.coalesce(2 * p / (1 + p), F.lit(0.0)))


# --- purity and exclusivity ---------------------------------------------------------------


def purity(df: DataFrame, sig: str, y: str = "y") -> DataFrame:
    """AGG5: how one-sided each signature is; ties lean to attack."""
    p = stats.ratio(F.col("n_attack"), F.col("n"))
    return (
        df.groupBy(sig)
        .agg(_n().alias("n"), _attacks(y).alias("n_attack"))
        .withColumns(
            {
                "n_benign": F.col("n") - F.col("n_attack"),
                "purity": F.greatest(p, 1 - p),
                "direction": F.when(
                    2 * F.col("n_attack") >= F.col("n"), "attack-leaning"
                ).otherwise("benign-leaning"),
            }
        )
    )


def purity_bands(table: DataFrame) -> DataFrame:
    """AGG6: signatures and volume per purity band (disjoint bands, empty ones too)."""
    bands = [
        (name, (F.col("purity") >= low) & (F.col("purity") < high))
        for name, low, high in C.PURITY_BANDS
    ]
    return _band_rows(table, bands)


def _band_rows(table: DataFrame, bands: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per band from one pass over a signature table with volume ``n``."""
    sums = []
    for i, (_, inside) in enumerate(bands):
        sums.append(F.count_if(inside).alias(f"s{i}"))
        sums.append(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias(f"v{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("band"),
                F.col(f"s{i}").alias("n_sig"),
                F.col(f"v{i}").alias("volume"),
                (100.0 * F.col(f"v{i}") / F.col("total")).alias("pct"),
            )
            for i, (name, _) in enumerate(bands)
        ]
    )
    return table.agg(F.sum("n").alias("total"), *sums).select(F.inline(rows))


def exposure(table: DataFrame, limit: float = 0.99) -> DataFrame:
    """AGG7: share of volume under signatures that give the label away."""
    return table.agg(
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(F.col("purity") >= limit, F.col("n"))), F.lit(0)).alias("n_exposed"),
    ).withColumn("exposure_pct", 100.0 * stats.ratio(F.col("n_exposed"), F.col("n_total")))


def top_by_volume(table: DataFrame, sig: str, k: int = 5) -> DataFrame:
    """SRT2: the k largest signatures."""
    return table.orderBy(F.col("n").desc(), F.col(sig)).limit(k)


def exclusivity(df: DataFrame, sig: str, y: str = "y") -> DataFrame:
    """AGG8: signatures and volume that occur in one class only, or in both."""
    side = (
        F.when(F.col("n_attack") == F.col("n"), "attack_only")
        .when(F.col("n_attack") == 0, "benign_only")
        .otherwise("mixed")
    )
    table = df.groupBy(sig).agg(_n().alias("n"), _attacks(y).alias("n_attack"))
    return table.groupBy(side.alias("side")).agg(
        _n().alias("n_sig"), F.sum("n").alias("volume"), F.sum("n_attack").alias("n_attack")
    )


def ratio_table(df: DataFrame, sig: str, y: str = "y") -> DataFrame:
    """AGG9: attack to benign ratio per signature (infinite without benign rows)."""
    table = fit_lookup(df, sig, y)
    return table.withColumn(
        "ratio",
        F.coalesce(stats.ratio(F.col("n_attack"), F.col("n_benign")), F.lit(float("inf"))),
    )


def ratio_bands(table: DataFrame) -> DataFrame:
    """AGG9: cumulative ratio bands and the strictly exclusive signatures."""
    bands = [(f">={t}", F.col("ratio") >= t) for t in C.RATIO_BANDS]
    return _band_rows(table, [*bands, ("exclusive", F.col("n_benign") == 0)])


# --- information --------------------------------------------------------------------------


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """AGG10: normalised mutual information, arithmetic mean of the entropies.

    From the sums of n log n over the joint and the two marginal counts. Two constant
    columns agree fully (1); one constant column carries no information (0).
    """
    joint = df.groupBy(a, b).agg(_n().alias("c"))
    parts = (
        joint.select(F.lit("joint").alias("part"), "c")
        .unionByName(joint.groupBy(a).agg(F.sum("c").alias("c")).select(F.lit("a").alias("part"), "c"))
        .unionByName(joint.groupBy(b).agg(F.sum("c").alias("c")).select(F.lit("b").alias("part"), "c"))
    )
    sums = parts.agg(
        F.sum(F.when(F.col("part") == "joint", F.col("c"))).alias("n"),
        *[F.sum(F.when(F.col("part") == p, stats.n_log_n(F.col("c")))).alias(p) for p in ("joint", "a", "b")],
    )
    h = {p: stats.entropy_from(F.col("n"), F.col(p)) for p in ("joint", "a", "b")}
    mean = (h["a"] + h["b"]) / 2
    mi = F.greatest(h["a"] + h["b"] - h["joint"], F.lit(0.0))
    return sums.select(
        "n", mi.alias("mi"), F.when(mean <= 1e-12, 1.0).otherwise(mi / mean).alias("nmi")
    )


def stacked(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form of a column block: keep, feature, value."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")


def mi_rank(
    df: DataFrame, columns: Sequence[str], y: str = "y", bins: int = 16, flag_share: float = 0.8
) -> DataFrame:
    """AGG11: mutual information (nats) of each feature with the label, ranked.

    The estimator is the plug-in one over equal-frequency bins (a value goes to the
    bin of its first rank, so ties stay together); it replaces a nearest-neighbour
    estimator on purpose. ``flagged``: at least ``flag_share`` of the largest value.
    """
    counts = staged(
        stacked(df, columns, [y])
        .filter("value IS NOT NULL")
        .groupBy("feature", "value", y)
        .agg(_n().alias("c"))
    )
    placed = running(
        counts.groupBy("feature", "value").agg(F.sum("c").alias("_n")),
        ["feature"],
        ["value"],
        [Running("_upto", "sum", F.col("_n"))],
    )
    totals = counts.groupBy("feature").agg(F.sum("c").alias("_total"))
    binned = placed.join(totals, "feature").select(
        "feature",
        "value",
        F.floor((F.col("_upto") - F.col("_n")) * bins / F.col("_total")).alias("bin"),
    )
    joint = (
        counts.join(binned, ["feature", "value"])
        .groupBy("feature", "bin", y)
        .agg(F.sum("c").alias("c"))
    )
    parts = (
        joint.select("feature", F.lit("joint").alias("part"), "c")
        .unionByName(
            joint.groupBy("feature", "bin").agg(F.sum("c").alias("c")).select("feature", F.lit("a").alias("part"), "c")
        )
        .unionByName(
            joint.groupBy("feature", y).agg(F.sum("c").alias("c")).select("feature", F.lit("b").alias("part"), "c")
        )
    )
    sums = parts.groupBy("feature").agg(
        F.sum(F.when(F.col("part") == "joint", F.col("c"))).alias("n"),
        *[F.sum(F.when(F.col("part") == p, stats.n_log_n(F.col("c")))).alias(p) for p in ("joint", "a", "b")],
    )
    h = {p: stats.entropy_from(F.col("n"), F.col(p)) for p in ("joint", "a", "b")}
    scored = sums.select(
        "feature", "n", F.greatest(h["a"] + h["b"] - h["joint"], F.lit(0.0)).alias("mi")
    )
    # at most as many rows as there are features
    best = F.max("mi").over(Window.partitionBy(F.lit(0)))
    return scored.withColumn("flagged", (F.col("mi") >= flag_share * best) & (best > 0))


def ranked_features(importance: DataFrame, gain: str) -> DataFrame:
    """SRT3: features by falling importance (one row per feature)."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(gain).desc(), "feature")
    return importance.withColumn("place", F.row_number().over(order).cast("long"))


def value_counts(df: DataFrame, field: str, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(field).isNotNull()).groupBy(*by, field).agg(_n().alias("c"))


def norm_entropy(df: DataFrame, field: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG12: entropy of the values over log of their number; 0 for at most one value."""
    sums = value_counts(df, field, by).groupBy(*by).agg(
        F.sum("c").alias("n"), _n().alias("n_distinct"), F.sum(stats.n_log_n(F.col("c"))).alias("_l")
    )
    h = stats.entropy_from(F.col("n"), F.col("_l")) / F.log(F.col("n_distinct").cast("double"))
    return sums.select(
        *by, "n", "n_distinct", F.when(F.col("n_distinct") > 1, h).otherwise(0.0).alias("norm_entropy")
    )


def top_values(df: DataFrame, field: str, by: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values per group; each map task passes on k rows per group."""
    order = Window.partitionBy(*by).orderBy(F.col("c").desc(), F.col(field))
    return (
        value_counts(df, field, by)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
    )


def diversity(df: DataFrame, field: str, y: str = "y") -> DataFrame:
    """AGG13: coverage, distinct values, top shares and entropy of a field per class."""
    totals = df.groupBy(y).agg(_n().alias("n_total"), F.count(field).alias("n_with_field"))
    spread = norm_entropy(df, field, [y]).drop("n")
    top = (
        top_values(df, field, [y], 5)
        .groupBy(y)
        .agg(
            F.sum(F.when(F.col("place") <= 1, F.col("c"))).alias("_1"),
            F.sum(F.when(F.col("place") <= 3, F.col("c"))).alias("_3"),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("place", F.col(field).cast("string").alias("v")))),
                    lambda t: t["v"],
                ),
                "|",
            ).alias("top_values"),
        )
    )
    joined = totals.join(spread, y, "left").join(top, y, "left")
    zero = F.lit(0.0)
    return joined.select(
        y,
        "n_total",
        "n_with_field",
        (100.0 * stats.ratio(F.col("n_with_field"), F.col("n_total"))).alias("coverage_pct"),
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        F.coalesce(stats.ratio(F.col("_1"), F.col("n_with_field")), zero).alias("top1_share"),
        F.coalesce(stats.ratio(F.col("_3"), F.col("n_with_field")), zero).alias("top3_share"),
        F.coalesce("norm_entropy", zero).alias("norm_entropy"),
        F.coalesce("top_values", F.lit("")).alias("top_values"),
    )


def value_overlap(df: DataFrame, field: str, y: str = "y") -> DataFrame:
    """AGG14: values seen in both classes and the volume they hold in each."""
    both = df.filter(F.col(field).isNotNull()).groupBy(field).agg(
        F.count_if(F.col(y) == 1).alias("a"), F.count_if(F.col(y) == 0).alias("b")
    )
    shared = (F.col("a") > 0) & (F.col("b") > 0)

    def share(c: str) -> Column:
        return 100.0 * stats.ratio(F.sum(F.when(shared, F.col(c)).otherwise(0)), F.sum(c))

    return both.agg(
        F.count_if(shared).alias("n_shared"),
        F.count_if(F.col("a") > 0).alias("n_attack_values"),
        F.count_if(F.col("b") > 0).alias("n_benign_values"),
        share("a").alias("attack_shared_pct"),
        share("b").alias("benign_shared_pct"),
    )


def coverage(df: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """AGG15: percentage of rows that carry each field."""
    return df.groupBy(*by).agg(
        *[(100.0 * F.count(f) / _n()).alias(f"{f}_pct") for f in fields], _n().alias("n")
    )


def mapping_coverage(df: DataFrame, rule: str, groups: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG16: how many alerts the semantic classification really maps."""
    mapped = is_mapped(F.col(rule), F.col(groups))
    return df.groupBy(*by).agg(
        _n().alias("total"),
        F.count_if(mapped).alias("clean"),
        F.count_if(~mapped).alias("other"),
        F.round(100.0 * F.count_if(mapped) / _n(), 1).alias("clean_pct"),
    )


def top_unmapped(df: DataFrame, rule: str, groups: str, k: int = 10) -> DataFrame:
    """AGG16: the most frequent unmapped rules."""
    rest = df.filter(~is_mapped(F.col(rule), F.col(groups)))
    return top_by_volume(rest.groupBy(rule).agg(_n().alias("n")), rule, k)


def top_signature_share(df: DataFrame, sig: str, y: str = "y") -> DataFrame:
    """AGG17: the largest attack signature and its share of the attacks."""
    counts = staged(df.filter(F.col(y) == 1).groupBy(sig).agg(_n().alias("n")))
    return top_by_volume(counts, sig, 1).withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


# --- label checks ---------------------------------------------------------------------------


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """AGG18: contingency table with one column per given value."""
    return df.groupBy(rows).agg(
        *[F.count_if(F.col(columns) == v).alias(f"n_{v.replace('.', '_')}") for v in values]
    )


def agreement(df: DataFrame, truth: str, assigned: str) -> DataFrame:
    """AGG18: agreement of two technique assignments where the first is known."""
    known = df.filter(F.col(truth).isNotNull())
    same = F.count_if(F.col(truth) == F.col(assigned))
    return known.agg(
        _n().alias("n"), same.alias("agree"), (100.0 * stats.ratio(same, _n())).alias("agree_pct")
    )


def contradictions(
    df: DataFrame, rule: str = "rule_id", assigned: str = "technique", path_truth: str = "path_technique"
) -> DataFrame:
    """AGG19: discriminative alerts whose assigned technique their rule or path denies.

    The path decides where it names a technique that the rule allows.
    """
    expected = F.create_map(
        *[
            x
            for r, ts in C.EXPECTED_TECHNIQUES.items()
            for x in (F.lit(r), F.array(*[F.lit(t) for t in ts]))
        ]
    )
    checked = (
        df.filter(~F.col(rule).isin(*C.INCIDENTAL_RULES))
        .withColumn("_allowed", F.try_element_at(expected, F.col(rule)))
        .filter(F.col("_allowed").isNotNull())
        .withColumn(
            "_truth",
            F.when(F.array_contains("_allowed", F.coalesce(path_truth, F.lit("-"))), F.col(path_truth)),
        )
    )
    wrong = F.when(F.col("_truth").isNotNull(), F.col(assigned) != F.col("_truth")).otherwise(
        ~F.array_contains("_allowed", F.col(assigned))
    )
    return (
        checked.filter(wrong)
        .withColumn("true_technique", F.coalesce("_truth", F.array_join(F.array_sort("_allowed"), "/")))
        .drop("_allowed", "_truth")
    )


def contradiction_counts(bad: DataFrame, rule: str = "rule_id", assigned: str = "technique") -> DataFrame:
    return bad.groupBy(rule, assigned, "true_technique").agg(_n().alias("n"))


def offset_test(df: DataFrame, offset: str, limit_s: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """AGG20: do the offsets of mislabelled alerts share one constant?"""
    by = list(by)
    span = df.filter(F.col(offset).isNotNull()).groupBy(*by).agg(
        F.count(offset).alias("n"), F.min(offset).alias("min_s"), F.max(offset).alias("max_s")
    )
    middle = upper_median(df, by, offset, "median_s")
    joined = span.join(middle, by) if by else span.withColumn("median_s", middle.scalar())
    return joined.withColumn("spread_s", F.col("max_s") - F.col("min_s")).withColumn(
        "verdict", F.when(F.col("spread_s") <= limit_s, "CONSTANT").otherwise("VARIABLE")
    )


def spot_check(
    df: DataFrame, checks: Mapping[str, str], rule: str = "rule_id", assigned: str = "technique"
) -> DataFrame:
    """AGG21: does every alert of a rule land in the technique it must?"""
    want = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in checks.items() for x in kv]), F.col(rule)
    )
    tested = df.withColumn("expected", want).filter(F.col("expected").isNotNull())
    hits = F.count_if(F.coalesce(F.col(assigned) == F.col("expected"), F.lit(False)))
    return tested.groupBy(rule, "expected").agg(
        _n().alias("n"), hits.alias("hits"), F.when(hits == _n(), "PASS").otherwise("FAIL").alias("verdict")
    )


def label_summary(df: DataFrame) -> DataFrame:
    """AGG34: counts per label and tier, with subtotals."""
    return (
        df.rollup("label", "label_confidence")
        .agg(_n().alias("n"))
        .select(
            F.coalesce("label", F.lit("ALL")).alias("label"),
            F.coalesce("label_confidence", F.lit("ALL")).alias("label_confidence"),
            "n",
        )
    )


def residual_ratio(df: DataFrame) -> DataFrame:
    """AGG34: (low tiers + uncertain) / attacks; not a proportion, may exceed 1."""
    attack = F.col("label") == "attack"
    low = F.count_if(attack & F.col("label_confidence").isin("LOW-time", "VLOW-time"))
    high = F.count_if(attack & F.col("label_confidence").startswith("HIGH"))
    uncertain = F.count_if(F.col("label") == "uncertain")
    return df.agg(
        F.count_if(attack).alias("n_attack"),
        high.alias("n_high"),
        low.alias("n_low"),
        uncertain.alias("n_uncertain"),
        stats.ratio(low + uncertain, F.count_if(attack)).alias("residual"),
    )


def tier_split(df: DataFrame) -> DataFrame:
    """AGG34: high and lower tiers per technique of the attack alerts."""
    high = F.count_if(F.col("label_confidence").startswith("HIGH"))
    return df.filter("label = 'attack'").groupBy("technique").agg(
        _n().alias("n"), high.alias("n_high"), (_n() - high).alias("n_lower")
    )


# --- dataset characterisation -----------------------------------------------------------------


def characterise(df: DataFrame, rule: str, description: str, y: str = "y", k: int = 10) -> DataFrame:
    """AGG22: the k largest rules, their modal description and attack share."""
    per_text = df.groupBy(rule, description).agg(_n().alias("c"), _attacks(y).alias("a"))
    # ties go to the alphabetically first description
    per_rule = per_text.groupBy(rule).agg(
        F.sum("c").alias("n"),
        F.sum("a").alias("n_attack"),
        F.count(description).alias("n_descriptions"),
        F.max("c").alias("_max"),
    )
    top = top_by_volume(per_rule, rule, k)
    named = (
        top.join(per_text.select(rule, description, "c"), rule)
        .filter(F.col("c") == F.col("_max"))
        .groupBy(rule, "n", "n_attack", "n_descriptions")
        .agg(F.min(description).alias("modal_description"))
    )
    return named.withColumn("attack_share_pct", 100.0 * F.col("n_attack") / F.col("n"))


def first_description(df: DataFrame, rule: str, description: str, order: str) -> DataFrame:
    """JN14: the description a rule carried first."""
    return df.groupBy(rule).agg(F.min_by(description, order).alias("description"))


def rate_stats(df: DataFrame, value: str, y: str = "y") -> DataFrame:
    """AGG23: count, mean and exact quantiles of a value per class."""
    df = staged(df.select(y, value))
    quantiles = exact_quantiles(
        df, [y], value, {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    )
    means = df.groupBy(y).agg(F.avg(value).alias("mean"), F.max(value).cast("double").alias("max"))
    return quantiles.join(means, y)


def class_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """AGG24, AGG28: median of every feature per class (long form)."""
    return exact_quantiles(
        stacked(df, columns, by), [*by, "feature"], "value", {"median": 0.5}
    )


def feature_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """AGG25: null share, distinct values, sample variance, constancy per group."""
    long = stacked(df, columns, by)
    per_value = long.groupBy(*by, "feature", "value").agg(_n().alias("c"))
    v, c = F.col("value"), F.col("c")
    present = F.when(v.isNotNull(), c)
    sums = per_value.groupBy(*by, "feature").agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(present), F.lit(0)).alias("_k"),
        F.count("value").alias("n_distinct"),
        (F.sum(v * c) / F.sum(present)).alias("_mean"),
    )
    # the mean is joined back so that the variance does not cancel
    around = per_value.join(sums.select(*by, "feature", "_mean"), [*by, "feature"]).groupBy(*by, "feature").agg(
        F.sum(c * (v - F.col("_mean")) * (v - F.col("_mean"))).alias("_ss")
    )
    both = sums.join(around, [*by, "feature"])
    var = F.when(F.col("_k") > 1, F.col("_ss") / (F.col("_k") - 1))
    return both.select(
        *by,
        "feature",
        "n",
        (100.0 * (F.col("n") - F.col("_k")) / F.col("n")).alias("null_pct"),
        "n_distinct",
        F.coalesce(var, F.lit(0.0)).alias("variance"),
        ((F.coalesce(var, F.lit(0.0)) < 1e-9) | (F.col("n_distinct") <= 1)).alias("is_constant"),
    )


def vector_collapse(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """AGG26: share of unique feature vectors after rounding to 6 places."""
    vectors = df.groupBy(*by, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in columns]).agg(
        _n().alias("c")
    )
    return vectors.groupBy(*by).agg(F.sum("c").alias("n"), _n().alias("n_unique")).withColumn(
        "unique_share", F.col("n_unique") / F.col("n")
    )


def duplicate_unanimity(df: DataFrame, columns: Sequence[str], hit: str) -> DataFrame:
    """AGG27: groups of equal vectors, and those whose members were not all decided alike."""
    groups = df.groupBy(*columns).agg(_n().alias("c"), F.count_if(F.col(hit) == 1).alias("h"))
    repeated = F.col("c") >= 2
    split = repeated & (F.col("h") > 0) & (F.col("h") < F.col("c"))
    return groups.agg(
        F.count_if(repeated).alias("n_groups"),
        F.count_if(split).alias("n_split"),
        F.coalesce(F.sum(F.when(split, F.col("c"))), F.lit(0)).alias("rows_in_split"),
    )


def run_summary(df: DataFrame, metric: str, by: Sequence[str], baseline: float | None = None) -> DataFrame:
    """AGG29: mean, sample deviation, 95 % interval and range of repeated runs."""
    s = df.groupBy(*by).agg(
        _n().alias("runs"),
        F.avg(metric).alias("mean"),
        F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("sd"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
    )
    half = 1.96 * F.col("sd") / F.sqrt(F.col("runs").cast("double"))
    s = s.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})
    return s if baseline is None else s.withColumn("gap", F.col("mean") - F.lit(float(baseline)))


def histogram(df: DataFrame, value: str, y: str = "y", cap: int = 20) -> DataFrame:
    """AGG31: percentage of each class per integer value, capped on top."""
    cells = df.groupBy(y, F.least(F.floor(value), F.lit(cap)).alias("bin")).agg(_n().alias("n"))
    share = F.sum("n").over(Window.partitionBy(y))  # at most cap + 1 rows per class
    return cells.withColumn("pct", 100.0 * F.col("n") / share)


def composition(df: DataFrame, rule: str, k: int = 5) -> DataFrame:
    """AGG32: share of the k largest rules and of all others together."""
    table = df.groupBy(rule).agg(_n().alias("n"))
    top = top_by_volume(table, rule, k).select(F.col(rule).alias("_top"))
    total = table.agg(F.sum("n")).scalar()
    marked = table.join(F.broadcast(top), F.col(rule) == F.col("_top"), "left")  # k rows
    name = F.coalesce("_top", F.lit("other"))
    return marked.groupBy(name.alias("rule")).agg(F.sum("n").alias("n")).withColumn(
        "pct", 100.0 * F.col("n") / total
    )


def type_breakdown(df: DataFrame, kind: str, rule: str) -> DataFrame:
    """AGG33: rules per attack type with their share of the type."""
    cells = df.filter(F.col(kind).isNotNull()).groupBy(kind, rule).agg(_n().alias("n"))
    totals = cells.groupBy(kind).agg(F.sum("n").alias("n_type"))
    return cells.join(totals, kind).withColumn("pct_of_type", 100.0 * F.col("n") / F.col("n_type"))


def set_agreement(df: DataFrame, hits: Sequence[str]) -> DataFrame:
    """AGG35: intersection, union, pairwise equality and single-model hits."""
    patterns = df.groupBy(*hits).agg(_n().alias("_n"))
    on = [F.col(h) == 1 for h in hits]
    count = sum((o.cast("int") for o in on), F.lit(0))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    pairs = [(i, j) for i in range(len(hits)) for j in range(i + 1, len(hits))]
    return patterns.agg(
        total(count == len(hits)).alias("n_all"),
        total(count > 0).alias("n_any"),
        *[(total(on[i] != on[j]) == 0).alias(f"same_{hits[i]}_{hits[j]}") for i, j in pairs],
        *[total(o & (count == 1)).alias(f"only_{h}") for o, h in zip(on, hits)],
    )


def fp_breakdown(df: DataFrame, rule: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """AGG36: false positives per rule, their rate and share of all of them."""
    benign = df.filter(F.col(y) == 0)
    table = benign.groupBy(rule).agg(F.count_if(F.col(pred) == 1).alias("fp"), _n().alias("n"))
    total = table.agg(F.sum("fp")).scalar()
    low, high = stats.wilson(F.col("fp"), F.col("n"))
    return table.withColumns(
        {
            "fpr_pct": 100.0 * F.col("fp") / F.col("n"),
            "share_pct": F.coalesce(100.0 * F.try_divide(F.col("fp").cast("double"), total), F.lit(0.0)),
            "wilson_low": low,
            "wilson_high": high,
        }
    )


def feature_bucket(corrected: bool = False) -> Column:
    """Bucket of a feature name: identity, behavioural, else correlated."""
    behavioural = C.BEHAVIOURAL_FEATURES_CORRECTED if corrected else C.BEHAVIOURAL_FEATURES
    return (
        F.when(F.col("feature").isin(*C.IDENTITY_FEATURES), "identity")
        .when(F.col("feature").isin(*behavioural), "behavioural")
        .otherwise("correlated")
    )


def bucket_attribution(importance: DataFrame, gain: str = "gain", corrected: bool = False) -> DataFrame:
    """AGG37: share of total importance per feature bucket, ranked."""
    table = importance.groupBy(feature_bucket(corrected).alias("bucket")).agg(
        F.sum(gain).alias("gain"), _n().alias("n_features")
    )
    every = Window.partitionBy(F.lit(0))  # three rows
    return table.withColumns(
        {
            "gain_pct": F.coalesce(100.0 * F.try_divide(F.col("gain"), F.sum("gain").over(every)), F.lit(0.0)),
            "place": F.row_number().over(every.orderBy(F.col("gain").desc(), "bucket")),
        }
    )


def feature_taxonomy(long: DataFrame, corrected: bool = False) -> DataFrame:
    """AGG38: features per bucket and their non-zero cells; input from ``stacked``."""
    per_feature = long.groupBy("feature").agg(F.count_if(F.col("value") != 0).alias("c"))
    return per_feature.groupBy(feature_bucket(corrected).alias("bucket")).agg(
        _n().alias("n_features"), F.sum("c").alias("n_nonzero")
    )


def scenario_mix(df: DataFrame, scenario: str, y: str = "y") -> DataFrame:
    """AGG39: rows and attack rate per scenario."""
    return df.groupBy(scenario).agg(
        _n().alias("n"), _attacks(y).alias("n_attack"), (_attacks(y) / _n()).alias("attack_rate")
    )


def rule_score(df: DataFrame, condition: Column, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """AGG40: score of a single threshold rule on the whole corpus."""
    called = F.coalesce(condition, F.lit(False)).cast("int")
    return confusion(df.withColumn("_called", called), y, "_called", by)


def separation(df: DataFrame, score: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """AGG41: medians and quartile ranges of a score per class, and their order."""
    by = list(by)
    q = exact_quantiles(df, [*by, y], score, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    wide = q.groupBy(*by).agg(
        *[
            F.max(F.when(F.col(y) == v, F.col("median"))).alias(f"{name}_median")
            for name, v in (("attack", 1), ("benign", 0))
        ],
        *[
            F.max(F.when(F.col(y) == v, F.col("q3") - F.col("q1"))).alias(f"{name}_iqr")
            for name, v in (("attack", 1), ("benign", 0))
        ],
    )
    return wide.withColumn(
        "separation",
        F.when(F.col("attack_median") > F.col("benign_median"), "CORRECT").otherwise("INVERTED"),
    )


def signature_distribution(train: DataFrame, test: DataFrame, sig: str, y: str = "y") -> DataFrame:
    """AGG42: class counts per signature in train and test, with the lookup label."""
    both = train.select(sig, y, F.lit(1).alias("_train")).unionByName(
        test.select(sig, y, F.lit(0).alias("_train"))
    )
    t, a = F.col("_train") == 1, F.col(y) == 1
    table = both.groupBy(sig).agg(
        F.count_if(t & a).alias("train_attack"),
        F.count_if(t & ~a).alias("train_benign"),
        F.count_if(~t & a).alias("test_attack"),
        F.count_if(~t & ~a).alias("test_benign"),
    )
    n_train = F.col("train_attack") + F.col("train_benign")
    return table.withColumns(
        {
            "lookup": F.when(n_train == 0, 0)
            .otherwise((F.col("train_attack") >= F.col("train_benign")).cast("int")),
            "unseen_in_train": n_train == 0,
        }
    )


def unseen_share(table: DataFrame) -> DataFrame:
    """AGG42: test rows whose signature was never seen in train."""
    n = F.col("test_attack") + F.col("test_benign")
    unseen = F.coalesce(F.sum(F.when(F.col("unseen_in_train"), n)), F.lit(0))
    return table.agg(
        F.count_if(F.col("unseen_in_train")).alias("unseen_signatures"),
        unseen.alias("unseen_rows"),
        (100.0 * stats.ratio(unseen, F.sum(n))).alias("unseen_pct"),
    )


def detection_note(df: DataFrame, by: str, hit1: str, hit2: str) -> DataFrame:
    """AGG43: recall of both layers and their OR per technique, with a note (percent)."""
    a, b = F.col(hit1) == 1, F.col(hit2) == 1
    n = _n()
    r = df.groupBy(by).agg(
        n.alias("n"),
        (100.0 * F.count_if(a) / n).alias("l1_recall"),
        (100.0 * F.count_if(b) / n).alias("l2_recall"),
        (100.0 * F.count_if(a | b) / n).alias("either_recall"),
    )
    return r.withColumn(
        "note",
        F.when(F.greatest("l1_recall", "l2_recall") < 50, "found by neither layer")
        .when(F.col("l1_recall") >= F.col("l2_recall"), "known-attack layer carries over")
        .otherwise("anomaly layer leads"),
    )


def pipelines_equal(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG44: whether two pipelines decide every row alike."""
    differ = F.count_if(~F.col(a).eqNullSafe(F.col(b)))
    return df.groupBy(*by).agg(
        _n().alias("n"), differ.alias("n_different"), (differ == 0).alias("equal")
    )
