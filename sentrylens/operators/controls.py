"""The seven data controls and their matrix.

Every control returns the same row shape, so that a matrix is a plain union:
control, corpus, verdict, statistic (main number), detail.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions import stats
from sentrylens.operators.rounds import periodicity
from sentrylens.operators.trailing import mean_rate, peak_rate
from sentrylens.session import staged


def _passes(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def burst_overlap(
    df: DataFrame, value: str, y: str = "y", by: Sequence[str] = (), cap: float | None = None,
    high: float = C.CONTROL_HIGH, negligible: float = C.CONTROL_NEGLIGIBLE, strict_spec: bool = False,
) -> DataFrame:
    """CTL1: can the benign class reach the attack class's range of a feature?

    With a cap only the density at the cap decides, not the ranges; ``strict_spec``
    also fails on ranges that do not touch, as the written specification has it.
    """
    a, b = F.col(y) == 1, F.col(y) == 0
    stats_ = df.groupBy(*by).agg(
        F.min(F.when(a, F.col(value))).cast("double").alias("attack_min"),
        F.max(F.when(b, F.col(value))).cast("double").alias("benign_max"),
        *(
            [
                F.avg(F.when(a, (F.col(value) >= cap).cast("double"))).alias("p_attack_at_cap"),
                F.avg(F.when(b, (F.col(value) >= cap).cast("double"))).alias("p_benign_at_cap"),
            ]
            if cap is not None
            else []
        ),
    )
    overlap = F.col("benign_max") >= F.col("attack_min")
    if cap is None:
        ok = overlap
    else:
        dense = (F.col("p_attack_at_cap") >= high) & (F.col("p_benign_at_cap") <= negligible)
        ok = ~dense & overlap if strict_spec else ~dense
    return stats_.withColumns({"range_overlap": overlap, "verdict": _passes(F.coalesce(ok, F.lit(False)))})


def event_presence(df: DataFrame, event: Column, by: Sequence[str] = ()) -> DataFrame:
    """CTL2: the benign corpus must contain the event class at all.

    With several platforms (``by``), ``worst_case`` gives the overall verdict.
    """
    return df.groupBy(*by).agg(
        F.count_if(event).alias("n_events"), F.count(F.lit(1)).alias("n_benign")
    ).withColumn("verdict", _passes(F.col("n_events") > 0))


def worst_case(df: DataFrame) -> DataFrame:
    """CTL2: FAIL as soon as one platform fails."""
    return df.agg(F.min("verdict").alias("verdict"), F.min("n_events").alias("n_events"))


def rule_composition(
    df: DataFrame, rule: str, y: str = "y", by: Sequence[str] = (),
    negligible: float = C.CONTROL_NEGLIGIBLE, strict_spec: bool = False,
) -> DataFrame:
    """CTL3: a rule above half of one class and negligible in the other confounds it.

    By default a rule that dominates the benign class and never occurs in an attack is
    not reported (the comparison starts from a zero attack share); ``strict_spec``
    reports it too.
    """
    by = list(by)
    counts = df.groupBy(*by, rule).agg(
        F.count_if(F.col(y) == 1).alias("_a"), F.count_if(F.col(y) == 0).alias("_b")
    )
    totals = counts.groupBy(*by).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    if by:
        joined = counts.join(totals, by)
    else:
        joined = counts.withColumns(
            {"_na": totals.select("_na").scalar(), "_nb": totals.select("_nb").scalar()}
        )
    a = F.coalesce(stats.ratio(F.col("_a"), F.col("_na")), F.lit(0.0))
    b = F.coalesce(stats.ratio(F.col("_b"), F.col("_nb")), F.lit(0.0))
    one_sided = ((a > 0.5) & (b <= negligible)) | ((b > 0.5) & (a <= negligible))
    counted = one_sided if strict_spec else one_sided & (a > 0)
    worst = joined.groupBy(*by).agg(
        F.max(F.when(counted, F.struct(a.alias("attack_share"), b.alias("benign_share"), F.col(rule).alias("rule")))).alias("_w")
    )
    return worst.select(
        *by,
        F.coalesce(F.col("_w.rule").cast("string"), F.lit("None")).alias("dominant_rule"),
        F.coalesce("_w.attack_share", F.lit(0.0)).alias("attack_share"),
        F.coalesce("_w.benign_share", F.lit(0.0)).alias("benign_share"),
        _passes(F.col("_w").isNull()).alias("verdict"),
    )


def verdict_stability(runs: DataFrame, setting_verdict: str, by: Sequence[str] = ()) -> DataFrame:
    """CTL4: the verdict must be the same under every setting; a setting without one counts as another verdict."""
    n = F.countDistinct(F.coalesce(setting_verdict, F.lit("none")))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_settings"), n.alias("n_verdicts"), _passes(n == 1).alias("verdict")
    )


def gap_verdict(f1: Column, lookup_f1: Column, tolerance: float = 0.01) -> Column:
    """CTL4: does the gap between model and lookup survive in this run?"""
    return F.when(F.abs(f1 - lookup_f1) < tolerance, "gap survives").otherwise("gap closes")


def run_settings(settings: Mapping[str, object], fit_and_score: Callable[[Mapping[str, object]], DataFrame]) -> DataFrame:
    """CTL4: one row for each named setting, with the verdict and metrics that ``fit_and_score`` gives it.

    The caller gets all settings at once, so that their fits run side by side and share their
    inputs; it returns rows with a column ``setting``. A setting it leaves out has nulls.
    """
    runs = fit_and_score(settings)
    names = runs.sparkSession.createDataFrame([(s,) for s in settings], "setting string")
    return names.join(runs, "setting", "left")


def capture_tempo(
    df: DataFrame, time: str, row_id: str, y: str = "y", by: Sequence[str] = (),
    far: float = C.TEMPO_FAR_FROM_ONE, window_s: int = 10,
) -> DataFrame:
    """CTL5: attack to benign ratio of mean and peak rate; far from one is suspect."""
    by = list(by)
    mean = mean_rate(df, [*by, y], time).select(*by, y, "mean_rate")
    peak = peak_rate(df, [*by, y], time, row_id, window_s)
    both = mean.join(peak, [*by, y])

    def of(column: str, v: int) -> Column:
        return F.max(F.when(F.col(y) == v, F.col(column)))

    return (
        both.groupBy(*by)
        .agg(
            F.try_divide(of("mean_rate", 1), of("mean_rate", 0)).alias("mean_ratio"),
            F.try_divide(of("peak_rate", 1), of("peak_rate", 0)).alias("peak_ratio"),
        )
        .withColumn("flagged", tempo_flag(F.col("mean_ratio"), F.col("peak_ratio"), far))
    )


def tempo_flag(mean_ratio: Column, peak_ratio: Column, far: float = C.TEMPO_FAR_FROM_ONE) -> Column:
    def off(r: Column) -> Column:
        return F.coalesce((r >= far) | (r <= 1 / far), F.lit(False))

    return off(mean_ratio) | off(peak_ratio)


def claim_provenance(claims: DataFrame | None, artefacts: DataFrame, source: str = "source_file") -> DataFrame:
    """CTL6: every claim names only existing artefacts (``;``-separated, at least one).

    ``artefacts`` is the registry of known paths (column ``path``). No claims: PASS; no
    claim table at all: FAIL.
    """
    if claims is None:
        return artefacts.sparkSession.sql(
            "SELECT 0L AS n_claims, 0L AS n_missing, 'FAIL' AS verdict"
        )
    bad = missing_claims(claims, artefacts, source)
    return claims.agg(F.count(F.lit(1)).alias("n_claims")).withColumn(
        "n_missing", bad.agg(F.count(F.lit(1))).scalar()
    ).withColumn("verdict", _passes(F.col("n_missing") == 0))


def missing_claims(
    claims: DataFrame, artefacts: DataFrame, source: str = "source_file", claim_id: str = "claim_id"
) -> DataFrame:
    """CTL6: the claims without any name or with a name that does not exist."""
    names = F.filter(
        F.transform(F.split(F.coalesce(source, F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != ""
    )
    named = claims.select(claim_id, names.alias("_names"))
    nameless = named.filter(F.size("_names") == 0).select(claim_id)
    unknown = (
        named.select(claim_id, F.explode("_names").alias("path"))
        .join(artefacts.select("path").distinct(), "path", "left_anti")
        .select(claim_id)
        .distinct()
    )
    return nameless.unionByName(unknown)


def exact_matches(benign: DataFrame, inventory: DataFrame, column: str) -> DataFrame:
    """SET3: sorted distinct artefacts that occur in the benign window."""
    return benign.select(column).intersect(inventory.select(column)).orderBy(column)


def artifact_persistence(
    benign: DataFrame, path: str, inventory: Sequence[str], rules: Column, time: str, row_id: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """CTL7: no attack artefact in the benign window, and no clockwork rule.

    ``inventory`` is the fixed list of artefact paths; ``rules`` selects the alerts whose
    rhythm is tested.
    """
    by = list(by)
    found = benign.groupBy(*by).agg(
        F.countDistinct(F.when(F.col(path).isin(*inventory), F.col(path))).alias("n_matches")
    )
    rhythm = periodicity(benign.filter(rules), by, time, row_id).select(*by, "gap_cv", "is_periodic")
    if by:
        both = found.join(rhythm, by, "left")
    else:
        both = found.withColumn("_k", F.lit(1)).join(rhythm.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    periodic = F.coalesce("is_periodic", F.lit(False))
    return both.withColumns(
        {"is_periodic": periodic, "verdict": _passes((F.col("n_matches") == 0) & ~periodic)}
    )


def control_states(
    df: DataFrame, corpus: str, rule: str, time: str, rate: str, burst: str, gap: str,
    event: Column, pivot: Column, path: str, inventory: Sequence[str], y: str = "y",
    negligible: float = C.CONTROL_NEGLIGIBLE,
) -> DataFrame:
    """CTL8: what the controls need to know of each corpus, from one pass over its alerts.

    The rows are reduced once to a state of each (corpus, rule): class counts, extremes, spans, artefacts
    seen, gap moments. All of these merge, so the states of a corpus add up to its own; the shares of
    rules (CTL3) are then taken on the reduced rows. ``rate`` is the feature of CTL1, ``burst`` a row's trailing
    count within its class (CTL5), ``gap`` the seconds since the tested rule fired before, null elsewhere (CTL7).
    """
    attack, benign = F.col(y) == 1, F.col(y) == 0
    gap_s = F.col(gap).cast("double")
    sums = {
        "a": F.count_if(attack), "b": F.count_if(benign), "pa": F.count_if(attack & pivot), "pb": F.count_if(benign & pivot),
        "events": F.count_if(benign & event), "n_gaps": F.count(gap), "gaps": F.sum(gap_s), "gaps2": F.sum(gap_s * gap_s),
    }
    lows = {"attack_min": F.when(attack, F.col(rate)), "first_a": F.when(attack, F.col(time)), "first_b": F.when(benign, F.col(time))}
    highs = {
        "benign_max": F.when(benign, F.col(rate)), "last_a": F.when(attack, F.col(time)), "last_b": F.when(benign, F.col(time)),
        "burst_a": F.when(attack, F.col(burst)), "burst_b": F.when(benign, F.col(burst)),
    } | {f"seen_{i}": (benign & F.col(path).eqNullSafe(p)).cast("int") for i, p in enumerate(inventory)}
    per_rule = staged(
        df.groupBy(F.col(corpus).alias("corpus"), F.col(rule).alias("rule")).agg(
            *[v.alias(k) for k, v in sums.items()], *[F.min(v).alias(k) for k, v in lows.items()], *[F.max(v).alias(k) for k, v in highs.items()]
        )
    )
    whole = per_rule.groupBy("corpus").agg(
        *[F.sum(k).alias(k) for k in sums], *[F.min(k).alias(k) for k in lows], *[F.max(k).alias(k) for k in highs]
    )

    def confounds(a: str, b: str) -> Column:
        x = F.coalesce(stats.ratio(F.col(f"r.{a}"), F.col(f"w.{a}")), F.lit(0.0))
        z = F.coalesce(stats.ratio(F.col(f"r.{b}"), F.col(f"w.{b}")), F.lit(0.0))
        return F.max(((((x > 0.5) & (z <= negligible)) | ((z > 0.5) & (x <= negligible))) & (x > 0)).cast("int"))

    shares = per_rule.alias("r").join(whole.alias("w"), F.col("r.corpus").eqNullSafe(F.col("w.corpus"))).groupBy(F.col("r.corpus").alias("_c")).agg(
        confounds("a", "b").alias("rule_confounds"), confounds("pa", "pb").alias("pivot_confounds")
    )
    return whole.join(shares, F.col("corpus").eqNullSafe(F.col("_c"))).drop("_c")


def control_cells(states: DataFrame, extra: str, n_artefacts: int, far: float = C.TEMPO_FAR_FROM_ONE, window_s: int = 10) -> DataFrame:
    """CTL8: the cells of CTL1, 2, 3, 5 and 7 of every corpus; ``extra`` marks the rule check on the whole corpus."""
    def speed(c: str) -> Column:
        span = (F.col(f"last_{c}") - F.col(f"first_{c}")) / F.lit(1e6)
        return F.when(span > 0, F.col(c) / span)

    mean_ratio = F.try_divide(speed("a"), speed("b"))
    peak_ratio = F.try_divide(F.col("burst_a") / float(window_s), F.col("burst_b") / float(window_s))
    mean = F.col("gaps") / F.nullif(F.col("n_gaps"), F.lit(0))
    spread = F.sqrt(F.greatest(F.col("gaps2") / F.nullif(F.col("n_gaps"), F.lit(0)) - mean * mean, F.lit(0.0)))
    periodic = (F.col("n_gaps") >= C.PERIODICITY_MIN_N) & (mean > 0) & (spread / F.nullif(mean, F.lit(0.0)) <= C.PERIODICITY_CV)
    matches = reduce(lambda x, z: x + z, [F.col(f"seen_{i}") for i in range(n_artefacts)], F.lit(0))
    corpus = F.col("corpus").cast("string")

    def cell(control: str, at: Column, ok: Column, words: tuple[str, str] = ("pass", "fail")) -> Column:
        verdict = F.when(F.coalesce(ok, F.lit(False)), words[0]).otherwise(words[1])
        return F.struct(F.lit(control).alias("control"), at.alias("corpus"), verdict.alias("verdict"))

    cells = [
        cell("C1", corpus, F.col("benign_max") >= F.col("attack_min")),
        cell("C2", corpus, F.col("events") > 0),
        cell("C3", corpus, F.col("pivot_confounds") == 0),
        cell("C3", F.concat(corpus, F.lit(extra)), F.col("rule_confounds") == 0),
        cell("C5", corpus, tempo_flag(mean_ratio, peak_ratio, far), ("flagged", "not flagged")),
        cell("C7", corpus, (matches == 0) & ~F.coalesce(periodic, F.lit(False))),
    ]
    return states.select(F.inline(F.array(*cells)))


def verdict_row(control: str, corpus: Column, df: DataFrame, verdict: Column | None = None) -> DataFrame:
    """CTL8: a control's result as matrix rows."""
    return df.select(
        F.lit(control).alias("control"),
        corpus.cast("string").alias("corpus"),
        F.lower(verdict if verdict is not None else F.col("verdict")).alias("verdict"),
    )


def verdict_matrix(
    rows: Sequence[DataFrame], expected: Mapping[tuple[str, str], str], cited: Sequence[tuple[str, str]] = (),
    absent: Mapping[tuple[str, str], str] | None = None, extra: str | None = None,
) -> DataFrame:
    """CTL8: all verdicts next to the expected ones.

    ``absent`` are cells that a control is not applied to, with the wording that stands in for a verdict. Cited cells,
    cells expected as ``n/a`` and rows beside the table (corpus ending in ``extra``) are shown but not compared.
    """
    every = reduce(DataFrame.unionByName, rows)
    key = F.concat_ws("|", "control", "corpus")
    absent = absent or {}
    if absent:
        said = every.sparkSession.createDataFrame([(c, k, v) for (c, k), v in absent.items()], every.select("control", "corpus", "verdict").schema)
        every = every.filter(~key.isin(*[f"{c}|{k}" for c, k in absent])).unionByName(said)
    pairs = [F.lit(x) for (c, k), v in expected.items() for x in (f"{c}|{k}", v)]
    want = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")
    is_cited = key.isin(*[f"{c}|{k}" for c, k in cited]) if cited else F.lit(False)
    is_extra = F.col("corpus").endswith(extra) if extra else F.lit(False)
    return every.withColumns(
        {
            "expected": F.coalesce(want, F.lit("-")),
            "status": F.when(is_extra, "beside the table")
            .when(is_cited, "cited")
            .when(want.isNull(), "unexpected cell")
            .when(want == "n/a", "not compared")
            .when(want == F.col("verdict"), "match")
            .otherwise("MISMATCH"),
        }
    )


def sweep(
    values: Sequence[float], run: Callable[[float], DataFrame], by: Sequence[str] = ()
) -> DataFrame:
    """CTL9: rerun a control per parameter value; does any verdict flip?"""
    runs = reduce(
        DataFrame.unionByName, [run(v).select(*by, "verdict").withColumn("parameter", F.lit(float(v))) for v in values]
    )
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_values"), (F.countDistinct("verdict") > 1).alias("flips")
    )
