"""Queries for thresholds (THR), decisions (MOD), counterfactuals (CFX) and controls (CTL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions import flags, stats
from sentrylens.operators import audit, controls, decisions, features, models, rounds, splits, trailing
from sentrylens.operators import thresholds as T
from sentrylens.operators.labels import label_asof
from sentrylens.plans import views as V
from sentrylens.plans.q_audit import _CELLS, _LONG, _MI, _RATE10, _RATES, _rated, rounded
from sentrylens.plans.registry import query
from sentrylens.session import staged

_SCORES = "SELECT *, value / 500.0::DOUBLE AS score FROM labelled"


def _scores(spark, sf):
    return V.labelled(spark, sf, stage=True).withColumn("score", F.col("value") / F.lit(500.0))


def _grid_sql(n: int, low: str, high: str, scores: str = "scores", by: str = "collection") -> str:
    """Full pass per grid point: the plain definition of the curve."""
    return f"""SELECT s.{by}, g.i AS grid_no, any_value(g.t) AS threshold, count(*) FILTER (y = 1 AND score >= g.t) AS tp,
      count(*) FILTER (y = 0 AND score >= g.t) AS fp, count(*) FILTER (y = 1 AND score < g.t) AS fn,
      count(*) FILTER (y = 0 AND score < g.t) AS tn
    FROM {scores} s, (SELECT i + 1 AS i, CASE WHEN i = {n - 1} THEN {high} ELSE {low} + i * (({high} - {low}) / {n - 1}) END AS t
      FROM range({n}) r(i)) g GROUP BY s.{by}, g.i"""


_GRID200 = T.linear_grid(0.0, 1.0, 200)


@query(
    "thr1_cost_curve_optimum",
    V.check_sql(
        """SELECT collection, cost, round(threshold, 6) AS threshold, tp, fp, fn, tn FROM (SELECT *, fp + 10 * fn AS cost FROM g)
        QUALIFY row_number() OVER (PARTITION BY collection ORDER BY cost, grid_no) = 1""",
        "labelled", scores=_SCORES, g=_grid_sql(200, "0.0::DOUBLE", "1.0::DOUBLE"),
    ),
)
def thr1(spark, sf):
    curve = T.grid_curve(_scores(spark, sf), "score", _GRID200, by=["collection"])
    return rounded(T.cost_optimal(curve, ["collection"]))


@query(
    "thr2_zero_miss_threshold",
    V.check_sql(
        "SELECT collection, round(max(threshold) FILTER (fn = 0), 6) AS threshold FROM g GROUP BY collection",
        "labelled", scores=_SCORES, g=_grid_sql(200, "0.0::DOUBLE", "1.0::DOUBLE"),
    ),
)
def thr2(spark, sf):
    curve = T.grid_curve(_scores(spark, sf), "score", _GRID200, by=["collection"])
    return rounded(T.zero_fn(curve, ["collection"]))


_LOW, _HIGH = "(SELECT min(score) + 1e-6::DOUBLE FROM scores)", "(SELECT max(score) - 1e-6::DOUBLE FROM scores)"
_BEST = """SELECT collection, round(f1, 6) AS f1, round(threshold, 6) AS threshold FROM (SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM {0})
    QUALIFY row_number() OVER (PARTITION BY collection ORDER BY f1 DESC, threshold) = 1"""


@query(
    "thr3_max_f1_grid",
    V.check_sql(_BEST.format("g"), "labelled", scores=_SCORES, g=_grid_sql(300, _LOW, _HIGH)),
)
def thr3(spark, sf):
    s = _scores(spark, sf)
    return rounded(T.max_f1(T.grid_curve(s, "score", T.f1_grid(s, "score"), by=["collection"]), ["collection"], 0.5))


_CURVE = """SELECT c.collection, c.score AS threshold, count(*) FILTER (s.y = 1 AND s.score >= c.score) AS tp,
    count(*) FILTER (s.y = 0 AND s.score >= c.score) AS fp, count(*) FILTER (s.y = 1 AND s.score < c.score) AS fn,
    count(*) FILTER (s.y = 0 AND s.score < c.score) AS tn
    FROM (SELECT DISTINCT collection, score FROM scores) c JOIN scores s USING (collection) GROUP BY c.collection, c.score"""


@query(
    "thr4_recall_at_fpr_budget",
    V.check_sql(
        """SELECT collection, round(tp * 1.0 / (tp + fn), 6) AS recall, round(fp * 1.0 / (fp + tn), 6) AS achieved_fpr, round(threshold, 6) AS threshold
        FROM curve WHERE fp * 1.0 / (fp + tn) <= 0.1 QUALIFY row_number() OVER (PARTITION BY collection ORDER BY threshold) = 1""",
        "labelled", scores=_SCORES, curve=_CURVE,
    ),
)
def thr4(spark, sf):
    return rounded(T.recall_at_fpr(T.score_curve(_scores(spark, sf), "score", by=["collection"]), 0.10, ["collection"]))


@query(
    "thr5_best_f1_unique_scores",
    V.check_sql(_BEST.format("curve"), "labelled", scores=_SCORES, curve=_CURVE),
)
def thr5(spark, sf):
    return rounded(T.max_f1(T.score_curve(_scores(spark, sf), "score", by=["collection"]), ["collection"]))


@query(
    "thr6_benign_p99_rate_rule",
    V.check_sql(
        """SELECT collection, round(threshold, 6) AS threshold, round(count(*) FILTER (y = 1 AND rate > threshold) * 1.0 / count(*) FILTER (y = 1), 6) AS recall,
        round(count(*) FILTER (y = 0 AND rate > threshold) * 1.0 / count(*) FILTER (y = 0), 6) AS fpr
        FROM r JOIN (SELECT collection, quantile_cont(rate, 0.99) AS threshold FROM r WHERE y = 0 GROUP BY 1) USING (collection) GROUP BY collection, threshold""",
        "labelled", r=_RATE10,
    ),
)
def thr6(spark, sf):
    return rounded(T.benign_percentile(_rated(spark, sf), "rate", 0.99, by=["collection"], strict=True))


@query(
    "thr6_benign_p90_score",
    V.check_sql(
        """SELECT round(threshold, 6) AS threshold, round(count(*) FILTER (y = 1 AND score >= threshold) * 1.0 / count(*) FILTER (y = 1), 6) AS recall,
        round(count(*) FILTER (y = 0 AND score >= threshold) * 1.0 / count(*) FILTER (y = 0), 6) AS fpr
        FROM scores, (SELECT quantile_cont(score, 0.9) AS threshold FROM scores WHERE y = 0) GROUP BY threshold""",
        "labelled", scores=_SCORES,
    ),
)
def thr6_p90(spark, sf):
    return rounded(T.benign_percentile(_scores(spark, sf), "score", 0.90))


@query(
    "thr7_sign_vs_calibrated",
    V.check_sql(
        """SELECT collection, count(*) AS n, round(count(*) FILTER (score - 0.1 >= 0) * 1.0 / count(*), 6) AS fpr_sign,
        round(count(*) FILTER (score - 0.1 >= 0.15) * 1.0 / count(*), 6) AS fpr_calibrated FROM scores WHERE y = 0 GROUP BY collection""".replace("score - 0.1", "(score - 0.1::DOUBLE)"),
        "labelled", scores=_SCORES,
    ),
)
def thr7(spark, sf):
    s = _scores(spark, sf).filter("y = 0").withColumn("shifted", F.col("score") - F.lit(0.1))
    return rounded(T.threshold_table(s, "shifted", {"sign": 0.0, "calibrated": 0.15}, ["collection"]))


@query(
    "thr8_threshold_sweep_one_layer_fixed",
    V.check_sql(
        """SELECT grid_no, round(threshold, 6) AS threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
        round(sum(tp) * 1.0 / (sum(tp) + sum(fn)), 6) AS recall, round(sum(fp) * 1.0 / (sum(fp) + sum(tn)), 6) AS fpr FROM g GROUP BY grid_no, threshold""",
        "labelled",
        scores="SELECT * REPLACE (CASE WHEN level = 12 THEN 9.0 ELSE k / 100.0::DOUBLE END AS score) FROM (SELECT *, 0.0::DOUBLE AS score FROM labelled)",
        g=_grid_sql(21, "0.0::DOUBLE", "1.0::DOUBLE"),
    ),
)
def thr8(spark, sf):
    s = V.labelled(spark, sf).withColumn("score", F.col("k") / F.lit(100.0))
    curve = T.grid_curve(s, "score", T.linear_grid(0.0, 1.0, 21), always=F.col("level") == 12)
    n = F.col("n_attack")
    return rounded(
        curve.select(
            F.col("grid_no").cast("long").alias("grid_no"), "threshold", "tp", "fp",
            (F.col("tp") / n).alias("recall"), (F.col("fp") / F.col("n_benign")).alias("fpr"),
        )
    )


@query(
    "thr9_reproducibility_gate",
    V.check_sql(
        f"""SELECT collection, abs(recall - 0.5) <= 0.02 AND abs(fpr - 0.13) <= 0.02 AS reproduced FROM (SELECT collection, {_RATES}
        FROM (SELECT collection, {_CELLS} FROM (SELECT *, CAST(level >= 8 AS INT) AS pred FROM labelled) GROUP BY collection))""",
        "labelled",
    ),
)
def thr9(spark, sf):
    c = audit.rule_score(V.labelled(spark, sf), F.col("level") >= 8, by=["collection"])
    return T.reproduces(rounded(c), {"recall": 0.5, "fpr": 0.13}).select("collection", "reproduced")


@query(
    "thr10_target_status",
    V.check_sql(
        f"""SELECT collection, CASE WHEN f1 >= 0.95 THEN 'MET' ELSE 'NOT MET' END AS f1_status, CASE WHEN fnr <= 0.05 THEN 'MET' ELSE 'NOT MET' END AS fnr_status,
        CASE WHEN fpr <= 0.1 THEN 'MET' ELSE 'NOT MET' END AS fpr_status FROM (SELECT collection, {_RATES}
        FROM (SELECT collection, {_CELLS} FROM (SELECT *, CAST(level >= 8 AS INT) AS pred FROM labelled) GROUP BY collection))""",
        "labelled",
    ),
)
def thr10(spark, sf):
    c = audit.rule_score(V.labelled(spark, sf), F.col("level") >= 8, by=["collection"])
    return T.target_status(c).select("collection", "f1_status", "fnr_status", "fpr_status")


# --- decisions ------------------------------------------------------------------------------------

_Z = ("value", "level", "k")


def _distance_sql(cols, table: str, where: str) -> str:
    return " + ".join(
        f"power(({c} - (SELECT avg({c}) FROM {table} WHERE {where})) / (SELECT stddev_pop({c}) FROM {table} WHERE {where}), 2)"
        for c in cols
    )


_DIST = f"SELECT *, {_distance_sql(_Z, 'labelled', 'y = 0')} AS score FROM labelled"


def _distance(spark, sf):
    l = V.labelled(spark, sf, stage=True)
    scaler = decisions.fit_distance(l.filter("y = 0"), _Z)
    return l.withColumn("score", decisions.distance_score(_Z, scaler)), scaler


@query(
    "thr11_roc_auc_per_collection",
    V.check_sql(
        """SELECT collection, CAST(sum(y) AS BIGINT) AS n_attack, CAST(count(*) - sum(y) AS BIGINT) AS n_benign,
        round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc
        FROM (SELECT collection, y, rank() OVER (PARTITION BY collection ORDER BY score)
        + (count(*) OVER (PARTITION BY collection, score) - 1) / 2.0 AS r FROM d) GROUP BY collection""",
        "labelled", d=_DIST,
    ),
)
def thr11(spark, sf):
    return rounded(T.auc(_distance(spark, sf)[0], "score", by=["collection"]))


@query("mod2_distance_anomaly_score", V.check_sql("SELECT row_id, round(score, 6) AS score FROM d", "labelled", d=_DIST))
def mod2(spark, sf):
    return rounded(_distance(spark, sf)[0].select("row_id", "score"))



@query(
    "mod2_distance_embeddings",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    s AS (SELECT i, avg(v) AS m, coalesce(nullif(stddev_pop(v), 0), 1) AS d FROM x WHERE label = 0 GROUP BY i)
    SELECT vec_id, round(sum(power((v - m) / d, 2)), 6) AS score FROM x JOIN s USING (i) GROUP BY vec_id""",
)
def mod2_embeddings(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    model = decisions.fit_array_distance(e.filter("label = 0"), "embedding")
    return rounded(e.select("vec_id", decisions.array_distance_score("embedding", model).alias("score")))


_DECIDE = """SELECT row_id, CASE WHEN hit1 THEN 'forward' WHEN s2 >= 0.8 THEN 'suspicious' ELSE 'suppress' END AS decision,
    CASE WHEN hit1 THEN 'known_attack' WHEN s2 >= 0.8 THEN 'zero_day_candidate' ELSE 'benign' END AS category,
    CASE WHEN hit1 THEN 'l1' WHEN s2 >= 0.8 THEN 'l2' ELSE 'none' END AS layer
    FROM (SELECT *, k / 100.0 AS s2, value / 500 >= 0.1{0} AS hit1 FROM alerts)"""


def _two_scores(spark, sf):
    return V.detailed_alerts(spark, sf).withColumns(
        {"s1": F.col("value") / 500, "s2": F.col("k") / F.lit(100.0), "crit": flags.agent_criticality(F.col("agent_name"))}
    )


@query("mod7_two_layer_decision", V.check_sql(_DECIDE.format(""), "alerts"))
def mod7(spark, sf):
    d = decisions.two_layer(F.col("s1"), F.col("s2"), 0.1, 0.8)
    return _two_scores(spark, sf).select("row_id", *[c.alias(n) for n, c in d.items()])


@query(
    "mod8_rule_deferral",
    V.check_sql(
        _DECIDE.format(" AND NOT (rule_id IN ('31101', '31151', '5710', '5501') AND scenario % 4 = 0)"), "alerts"
    ),
)
def mod8(spark, sf):
    d = decisions.two_layer(F.col("s1"), F.col("s2"), 0.1, 0.8, decisions.defers(F.col("rule_id"), F.col("crit")))
    return _two_scores(spark, sf).select("row_id", *[c.alias(n) for n, c in d.items()])


_LAYERS = "SELECT *, CAST(value >= 60 AS INT) AS h1, CAST(k >= 80 AS INT) AS h2 FROM labelled"


def _layers(spark, sf):
    return V.labelled(spark, sf).withColumns(
        {"h1": (F.col("value") >= 60).cast("int"), "h2": (F.col("k") >= 80).cast("int")}
    )


@query(
    "mod9_raw_combination",
    V.check_sql(
        f"SELECT tp, fp, tn, fn, {_RATES} FROM (SELECT {_CELLS} FROM (SELECT *, greatest(h1, h2) AS pred FROM x))",
        "labelled", x=_LAYERS,
    ),
)
def mod9(spark, sf):
    l = _layers(spark, sf).withColumn("pred", decisions.raw_combination(F.col("h1") == 1, F.col("h2") == 1))
    return rounded(audit.confusion(l))


@query(
    "mod9_first_layer_value",
    V.check_sql(
        """SELECT collection, round(dr, 6) AS recall_pp, round(df, 6) AS fpr_pp, CASE WHEN dr <= 1 AND df > 1 THEN 'more false alarms only'
        WHEN dr > 1 THEN 'more recall' ELSE 'about equal' END AS verdict FROM (SELECT collection,
          100.0 * count(*) FILTER (y = 1 AND h1 = 1 AND h2 = 0) / count(*) FILTER (y = 1) AS dr,
          100.0 * count(*) FILTER (y = 0 AND h1 = 1 AND h2 = 0) / count(*) FILTER (y = 0) AS df FROM x GROUP BY collection)""",
        "labelled", x=_LAYERS,
    ),
)
def mod9_value(spark, sf):
    return rounded(decisions.layer_value(_layers(spark, sf), "h1", "h2", by=["collection"]))


@query(
    "mod10_platform_routing",
    V.check_sql(
        """SELECT row_id, CAST(CASE scenario % 4 WHEN 0 THEN value / 500 >= 0.1 OR k / 100.0 >= 0.9 WHEN 1 THEN k / 100.0 >= 0.7
        ELSE false END AS INT) AS pred FROM alerts""",
        "alerts",
    ),
)
def mod10(spark, sf):
    routes = {"lnx-dmz-01": (True, 0.1, 0.9), "WIN-DC-2": (False, 0.0, 0.7)}
    pred = decisions.routed(F.col("agent_name"), routes, F.col("s1"), F.col("s2"))
    return _two_scores(spark, sf).select("row_id", pred.alias("pred"))


_MODELS = """SELECT 'value' AS model, y, technique, value / 500.0::DOUBLE AS score FROM labelled UNION ALL
    SELECT 'level', y, technique, level / 12.0::DOUBLE FROM labelled UNION ALL SELECT 'k', y, technique, k / 100.0::DOUBLE FROM labelled"""
_MODEL_CURVE = """SELECT c.model, c.score AS threshold, count(*) FILTER (s.y = 1 AND s.score >= c.score) AS tp,
    count(*) FILTER (s.y = 0 AND s.score >= c.score) AS fp, count(*) FILTER (s.y = 1) AS na, count(*) FILTER (s.y = 0) AS nb
    FROM (SELECT DISTINCT model, score FROM m) c JOIN m s USING (model) GROUP BY c.model, c.score"""


def _model_scores(spark, sf):
    l = V.labelled(spark, sf, carry=["technique"], stage=True)
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("model"), c.alias("score"))
            for n, c in (
                ("value", F.col("value") / 500.0), ("level", F.col("level") / 12.0), ("k", F.col("k") / 100.0)
            )
        ]
    )
    return l.select("y", "technique", F.explode(pairs).alias("p")).select("y", "technique", "p.*")


_MATRIX = """SELECT model, (SELECT max(tp * 1.0 / na) FROM mc WHERE mc.model = q.model AND fp * 1.0 / nb <= 0.1) AS r10,
    (SELECT min(threshold) FROM mc WHERE mc.model = q.model AND fp * 1.0 / nb <= 0.1) AS t10,
    (SELECT max(tp * 1.0 / na) FROM mc WHERE mc.model = q.model AND fp * 1.0 / nb <= 0.05) AS r05,
    (SELECT max(2.0 * tp / (tp + fp + na)) FROM mc WHERE mc.model = q.model) AS f1,
    median(score) FILTER (y = 1) AS am, median(score) FILTER (y = 0) AS bm FROM m q GROUP BY model"""


@query(
    "mod11_model_comparison_matrix",
    V.check_sql(
        """SELECT model, round(coalesce(r10, 0), 6) AS recall_at_10pct, round(coalesce(r05, 0), 6) AS recall_at_5pct,
        round(f1, 6) AS best_f1, round(am, 6) AS attack_median, round(bm, 6) AS benign_median,
        CASE WHEN am > bm THEN 'CORRECT' ELSE 'INVERTED' END AS separation FROM x""",
        "labelled", m=_MODELS, mc=_MODEL_CURVE, x=_MATRIX,
    ),
)
def mod11(spark, sf):
    return rounded(decisions.model_matrix(_model_scores(spark, sf)).drop("threshold_10pct"))


_PER_TECH = """SELECT model, technique, count(*) AS n, count(*) FILTER (score >= coalesce(t10, 1e300)) * 1.0 / count(*) AS recall
    FROM m JOIN x USING (model) WHERE y = 1 GROUP BY model, technique"""


@query(
    "mod11_recall_per_technique",
    V.check_sql(
        "SELECT model, technique, n, round(recall, 6) AS recall FROM pt",
        "labelled", m=_MODELS, mc=_MODEL_CURVE, x=_MATRIX, pt=_PER_TECH,
    ),
)
def mod11_technique(spark, sf):
    s = _model_scores(spark, sf)
    return rounded(decisions.recall_per_technique(s, decisions.model_matrix(s), "technique"))


@query(
    "mod12_outcome_classifier",
    V.check_sql(
        """SELECT n_quiet, n_wins, n_all_fail, round(gain, 6) AS gain, CASE WHEN n_wins > 0 AND gain > 0.2 THEN 'A'
          WHEN n_all_fail > 0 AND n_wins = 0 THEN 'B' ELSE 'C' END AS outcome
        FROM (SELECT count(*) FILTER (ref < 0.5 AND n >= 3) AS n_quiet, count(*) FILTER (ref < 0.5 AND n >= 3 AND alt - ref > 0.2) AS n_wins,
            count(*) FILTER (ref < 0.5 AND n >= 3 AND greatest(ref, alt) < 0.3) AS n_all_fail
          FROM (SELECT technique, max(n) AS n, max(recall) FILTER (model = 'k') AS ref, max(recall) FILTER (model <> 'k') AS alt FROM pt GROUP BY 1)),
        (SELECT max(coalesce(r10, 0)) FILTER (model <> 'k') - max(coalesce(r10, 0)) FILTER (model = 'k') AS gain FROM x)""",
        "labelled", m=_MODELS, mc=_MODEL_CURVE, x=_MATRIX, pt=_PER_TECH,
    ),
)
def mod12(spark, sf):
    s = _model_scores(spark, sf)
    matrix = decisions.model_matrix(s)
    per = decisions.recall_per_technique(s, matrix, "technique")
    return rounded(decisions.outcome(matrix, per, "technique", "k"))


@query(
    "mod13_saturation_flag",
    V.check_sql(
        """SELECT collection, round(avg(CAST(k >= 45 AS INT)), 6) AS benign_hit_share, avg(CAST(k >= 45 AS INT)) > 0.5 AS saturated
        FROM labelled WHERE y = 0 GROUP BY collection""",
        "labelled",
    ),
)
def mod13(spark, sf):
    l = V.labelled(spark, sf).withColumn("pred", (F.col("k") >= 45).cast("int"))
    return rounded(decisions.saturation(l, "pred", by=["collection"]))


# --- counterfactuals ----------------------------------------------------------------------------

_THETA = 3.0


def _hit_sql(swaps: dict[str, str]) -> str:
    return " + ".join(
        f"power(({swaps.get(c, c)} - (SELECT avg({c}) FROM labelled WHERE y = 0)) / (SELECT stddev_pop({c}) FROM labelled WHERE y = 0), 2)"
        for c in _Z
    ) + f" >= {_THETA}"


def _med(c: str, y: int) -> str:
    return f"(SELECT median({c}) FROM labelled WHERE y = {y})"


def _swap_query(spark, sf, rows_y, variants, by):
    l = V.labelled(spark, sf, carry=["technique"], stage=True)
    scaler = decisions.fit_distance(l.filter("y = 0"), _Z)
    return decisions.swap_recalls(l.filter(f"y = {rows_y}"), variants(l), _Z, scaler, _THETA, by)


@query(
    "cfx1_swap_to_benign_medians",
    V.check_sql(
        f"""SELECT technique, count(*) AS n, count(*) FILTER ({_hit_sql({})}) AS hits_original,
        count(*) FILTER ({_hit_sql({'value': _med('value', 0), 'level': _med('level', 0)})}) AS hits_swapped FROM labelled WHERE y = 1 GROUP BY technique""",
        "labelled",
    ),
)
def cfx1(spark, sf):
    def variants(l):
        return {"swapped": decisions.medians_of(l.filter("y = 0"), ("value", "level"))}

    return _swap_query(spark, sf, 1, variants, ["technique"])


@query(
    "cfx2_zeroed_block",
    V.check_sql(
        f"""SELECT technique, count(*) AS n, count(*) FILTER ({_hit_sql({})}) AS hits_original,
        count(*) FILTER ({_hit_sql({'value': '0.0', 'k': '0.0'})}) AS hits_zeroed FROM labelled WHERE y = 1 GROUP BY technique""",
        "labelled",
    ),
)
def cfx2(spark, sf):
    return _swap_query(spark, sf, 1, lambda l: {"zeroed": {"value": 0.0, "k": 0.0}}, ["technique"])


@query(
    "cfx3_mirror_control",
    V.check_sql(
        f"""SELECT collection, count(*) AS n, count(*) FILTER ({_hit_sql({})}) AS hits_original,
        count(*) FILTER ({_hit_sql({'value': _med('value', 1), 'level': _med('level', 1)})}) AS hits_poisoned FROM labelled WHERE y = 0 GROUP BY collection""",
        "labelled",
    ),
)
def cfx3(spark, sf):
    def variants(l):
        return {"poisoned": decisions.medians_of(l.filter("y = 1"), ("value", "level"))}

    return _swap_query(spark, sf, 0, variants, ["collection"])


@query(
    "cfx4_sequential_block_ablation",
    V.check_sql(
        f"""SELECT rule_id, count(*) AS n, count(*) FILTER ({_hit_sql({})}) AS hits_original,
        count(*) FILTER ({_hit_sql({'value': _med('value', 0)})}) AS hits_temporal,
        count(*) FILTER ({_hit_sql({'value': _med('value', 0), 'k': _med('k', 0)})}) AS hits_content,
        count(*) FILTER ({_hit_sql({c: _med(c, 0) for c in _Z})}) AS hits_identity FROM labelled WHERE y = 1 GROUP BY rule_id""",
        "labelled",
    ),
)
def cfx4(spark, sf):
    def variants(l):
        medians = decisions.medians_of(l.filter("y = 0"), _Z)
        return decisions.block_chain(
            medians, [("temporal", ("value",)), ("content", ("k",)), ("identity", ("level",))]
        )

    return _swap_query(spark, sf, 1, variants, ["rule_id"])


def _top_swap(c: str) -> str:
    top = "(SELECT feature FROM mi WHERE feature IN ('value', 'level', 'k') ORDER BY mi DESC, feature LIMIT 1)"
    return f"(CASE WHEN {top} = '{c}' THEN {_med(c, 0)} ELSE {c} END)"


@query(
    "cfx5_single_feature_swap",
    V.check_sql(
        f"""SELECT technique, count(*) AS n, count(*) FILTER ({_hit_sql({})}) AS hits_original,
        count(*) FILTER ({_hit_sql({c: _top_swap(c) for c in _Z})}) AS hits_top FROM labelled WHERE y = 1 GROUP BY technique""",
        "labelled", long=_LONG, mi=_MI,
    ),
)
def cfx5(spark, sf):
    def variants(l):
        top = audit.mi_rank(l, _Z).orderBy(F.col("mi").desc(), "feature").first()["feature"]
        return {"top": decisions.medians_of(l.filter("y = 0"), (top,))}

    return _swap_query(spark, sf, 1, variants, ["technique"])


# --- models: a fit has no SQL form, so SQL checks what is exact about it -------------------------

_TEMPORAL = """SELECT 'temporal' AS split, count(*) AS n_test, sum(y) AS n_attack, count(*) - sum(y) AS n_benign FROM (
    SELECT y, row_number() OVER (ORDER BY us, row_id) AS r, count(*) OVER () AS n FROM labelled) WHERE r > CAST(floor(0.8 * n) AS BIGINT)"""
_RANDOM = """SELECT 'random' AS split, sum(n - t) AS n_test, sum(CASE WHEN y = 1 THEN n - t END) AS n_attack,
    sum(CASE WHEN y = 0 THEN n - t END) AS n_benign FROM (
    SELECT y, count(*) AS n, CAST(round_even(0.8 * count(*), 0) AS BIGINT) AS t FROM labelled GROUP BY y)"""


def feature_rows(spark, sf):
    """26-feature rows with label, computed once for all fits."""
    flat = V.detailed_alerts(spark, sf).withColumn("message", F.lit(None).cast("string"))
    rows = features.features_v2(flat, ["scenario"], ["us", "row_id"], "us", keep=["row_id", "us", "scenario"])
    return staged(label_asof(rows, V.windows(spark, sf), ["scenario"]))


def _evaluated(rows, fits):
    """Confusion of each fit at its best threshold, on the test rows of its split."""
    cut = {}
    for name in dict.fromkeys(f.split for f in fits):
        temporal = name == "temporal"
        cut[name] = splits.temporal_split(rows, "us", "row_id") if temporal else splits.stratified_split(rows, "y", "row_id")
    trained, fills = models.fit_many({k: v.filter("split = 'train'") for k, v in cut.items()}, fits)
    tests = {k: v.filter("split = 'test'") for k, v in cut.items()}
    return models.best_f1(models.score_many(tests, fits, trained, fills))


def _exact(found, fits):
    """What a check can hold exactly: sizes, and whether the fit beats calling everything an attack."""
    sizes = {f.name: len(f.columns) for f in fits}
    width = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    trivial = stats.f1(F.col("n_attack"), F.col("n_benign"), F.lit(0))
    valid = (F.col("f1") >= trivial - 1e-6) & F.col("auc").between(0, 1)
    return found.groupBy("fit", "split").agg(
        F.count(F.lit(1)).alias("runs"),
        F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_test"),
        F.max(F.col("tp") + F.col("fn")).alias("n_attack"),
        F.max(F.col("fp") + F.col("tn")).alias("n_benign"),
        F.min(valid.cast("int")).cast("long").alias("trivial_beaten"),
    ).withColumn("n_features", width[F.col("fit")].cast("long"))


def _fit_check(fits):
    """The same in SQL."""
    runs = {}
    for f in fits:
        runs[f.name, f.split] = (runs.get((f.name, f.split), (0,))[0] + 1, len(f.columns))
    named = ", ".join(f"('{n}', '{s}', {r}, {w})" for (n, s), (r, w) in runs.items())
    return V.check_sql(
        f"""SELECT fit, split, CAST(runs AS BIGINT) AS runs, CAST(n_test AS BIGINT) AS n_test, CAST(n_attack AS BIGINT) AS n_attack,
        CAST(n_benign AS BIGINT) AS n_benign, CAST(1 AS BIGINT) AS trivial_beaten, CAST(n_features AS BIGINT) AS n_features
        FROM (VALUES {named}) t(fit, split, runs, n_features) JOIN (SELECT * FROM temporal UNION ALL SELECT * FROM random) USING (split)""",
        "labelled", temporal=_TEMPORAL, random=_RANDOM,
    )


_MOD1 = [models.Fit("full", C.FEATURES, "temporal")]
_MOD4 = [models.Fit(name, tuple(columns), "temporal") for name, columns in models.ABLATIONS.items()]
_MOD5 = [
    models.Fit(name, tuple(columns), split, seed)
    for name, columns in models.ABLATIONS.items() for split in ("random", "temporal") for seed in range(10)
]
_MINIMAL = ("alert_rate_1min", "alerts_10min", "time_since_last_alert", "line_count", "hour")
_MOD6 = [models.Fit("minimal", _MINIMAL, "random")]
_CFX6 = [
    models.Fit(name, columns, "temporal")
    for name, columns in (
        ("identity", C.IDENTITY_BLOCK), ("structural", C.TEMPORAL_BLOCK), ("both", C.IDENTITY_BLOCK + C.TEMPORAL_BLOCK),
    )
]


_STUMPS = models.Fit("stumps", ("level", "auth_failure", "kw_scan", "kw_brute", "k", "hour"), "temporal", trees=5, depth=1, bins=128, subsample=1.0)


def _with_hour(df):
    return df.withColumn("hour", F.hour(F.timestamp_micros("us")))


_EARLY = "row_number() OVER (ORDER BY us, row_id) <= CAST(floor(0.8 * count(*) OVER ()) AS BIGINT)"


def _drawn(seed):
    """Train rows of the stratified split, in SQL."""
    at = f"CAST('0x' || substr(md5('{seed}:' || CAST(row_id AS VARCHAR)), 1, 12) AS BIGINT)"
    return f"row_number() OVER (PARTITION BY y ORDER BY {at}, row_id) <= round_even(0.8 * count(*) OVER (PARTITION BY y), 0)"


def _stumps_sql(fit, name, train=_EARLY):
    """Boosting of one-split trees in SQL: every cut between values of every column, by weighted variance."""
    columns = [f"CAST({c} AS DOUBLE)" for c in fit.columns]
    parts = {
        f"{name}s0": f"""SELECT row_id, rule_id, y * 2 - 1 AS t, 0.0::DOUBLE AS margin, [{', '.join(columns)}] AS x, {train} AS train
            FROM (SELECT *, (us // 3600000000) % 24 AS hour FROM labelled)""",
        f"{name}w": f"SELECT count(*) FILTER (t = -1) / count(*) FILTER (t = 1) AS heavy FROM {name}s0 WHERE train",
    }
    for m in range(fit.trees):
        target = "CAST(t AS DOUBLE)" if m == 0 else "4.0 * t / (1.0 + exp(2.0 * t * margin))"
        parts[f"{name}v{m}"] = f"""SELECT i, x[i] AS v, sum(w) AS w, sum(w * r) AS s, sum(w * r * r) AS q
            FROM (SELECT x, unnest(range(1, {len(columns) + 1})) AS i, {target} AS r, CASE WHEN t = 1 THEN heavy ELSE 1.0 END AS w
              FROM {name}s{m}, {name}w WHERE train) GROUP BY ALL"""
        parts[f"{name}c{m}"] = f"""SELECT i, (v + lead(v) OVER up) / 2 AS cut, sum(w) OVER up AS wl, sum(s) OVER up AS sl, sum(q) OVER up AS ql,
            sum(w) OVER al AS wa, sum(s) OVER al AS sa, sum(q) OVER al AS qa
            FROM {name}v{m} WINDOW up AS (PARTITION BY i ORDER BY v), al AS (PARTITION BY i)"""
        parts[f"{name}b{m}"] = f"""SELECT i, cut, sl / wl AS low, (sa - sl) / (wa - wl) AS high FROM {name}c{m} WHERE cut IS NOT NULL
            ORDER BY round((qa - sa * sa / wa - (ql - sl * sl / wl) - (qa - ql - (sa - sl) * (sa - sl) / (wa - wl))) / wa, 10) DESC, i, cut LIMIT 1"""
        parts[f"{name}s{m + 1}"] = f"""SELECT row_id, rule_id, t, train, x,
            margin + {1.0 if m == 0 else models.RATE} * CASE WHEN x[i] <= cut THEN low ELSE high END AS margin FROM {name}s{m}, {name}b{m}"""
    parts[f"{name}out"] = f"""SELECT row_id, rule_id, CAST((t + 1) // 2 AS INT) AS y, 1 / (1 + exp(-2 * margin)) AS score, train
        FROM {name}s{fit.trees}"""
    return parts


@query(
    "mod1_boosted_stumps_scores",
    V.check_sql(
        "SELECT row_id, y, round(score, 6) AS score FROM out WHERE NOT train", "labelled", **_stumps_sql(_STUMPS, ""),
    ),
)
def mod1_stumps(spark, sf):
    l = _with_hour(V.labelled(spark, sf, stage=True))
    cut = splits.temporal_split(l, "us", "row_id")
    fitted, fills = models.fit_many({"temporal": cut.filter("split = 'train'")}, [_STUMPS])
    scored = models.score_many({"temporal": cut.filter("split = 'test'")}, [_STUMPS], fitted, fills, keep=["row_id"])
    return scored.select("row_id", "y", F.round("score", 6).alias("score"))


@query("mod1_boosted_trees_scores", _fit_check(_MOD1))
def mod1(spark, sf):
    return _exact(_evaluated(feature_rows(spark, sf), _MOD1), _MOD1)


@query(
    "mod3_feature_importance",
    "SELECT CAST({0} AS BIGINT) AS n_features, CAST({0} AS BIGINT) AS places, 1.0::DOUBLE AS total_gain, CAST(1 AS BIGINT) AS falling".format(len(C.FEATURES)),
)
def mod3(spark, sf):
    train = splits.temporal_split(feature_rows(spark, sf), "us", "row_id").filter("split = 'train'")
    fitted, _ = models.fit_many({"temporal": train}, _MOD1)
    ranked = spark.createDataFrame(models.importances(fitted[0], C.FEATURES), "place int, feature string, gain double")
    falls = F.coalesce(F.lag("gain").over(Window.orderBy("place")) >= F.col("gain"), F.lit(True))
    return ranked.withColumn("falls", falls).agg(
        F.countDistinct("feature").alias("n_features"), F.countDistinct("place").alias("places"),
        F.round(F.sum("gain"), 6).alias("total_gain"), F.min(F.col("falls").cast("long")).alias("falling"),
    )


@query("mod4_feature_ablation", _fit_check(_MOD4))
def mod4(spark, sf):
    return _exact(_evaluated(feature_rows(spark, sf), _MOD4), _MOD4)


@query("mod5_multi_seed_refits", _fit_check(_MOD5))
def mod5(spark, sf):
    return _exact(_evaluated(feature_rows(spark, sf), _MOD5), _MOD5)


@query("mod6_minimal_model", _fit_check(_MOD6))
def mod6(spark, sf):
    from sentrylens.operators.history import source_history

    l = V.labelled(spark, sf)
    h = source_history(l, ["collection"], ["us", "row_id"], "us")
    hour = F.hour(F.timestamp_micros("us"))
    rows = staged(h.withColumns({"line_count": F.col("k").cast("double"), "hour": hour.cast("double")}))
    return _exact(_evaluated(rows, _MOD6), _MOD6)


@query("cfx6_feature_tier_evaluation", _fit_check(_CFX6))
def cfx6(spark, sf):
    return _exact(_evaluated(feature_rows(spark, sf), _CFX6), _CFX6)


# --- controls -------------------------------------------------------------------------------------


_BURST = """SELECT collection, CAST(min(rate) FILTER (y = 1) AS DOUBLE) AS attack_min, CAST(max(rate) FILTER (y = 0) AS DOUBLE) AS benign_max,
    avg(CAST(rate >= 2 AS INT)) FILTER (y = 1) AS pa, avg(CAST(rate >= 2 AS INT)) FILTER (y = 0) AS pb FROM r GROUP BY collection"""


@query(
    "ctl1_burst_overlap",
    V.check_sql(
        """SELECT collection, attack_min, benign_max, benign_max >= attack_min AS range_overlap,
        CASE WHEN benign_max >= attack_min THEN 'PASS' ELSE 'FAIL' END AS verdict FROM b""",
        "labelled", r=_RATE10, b=_BURST,
    ),
)
def ctl1(spark, sf):
    return controls.burst_overlap(_rated(spark, sf), "rate", by=["collection"])


@query(
    "ctl1_burst_overlap_capped",
    V.check_sql(
        """SELECT collection, attack_min, benign_max, round(pa, 6) AS p_attack_at_cap, round(pb, 6) AS p_benign_at_cap,
        benign_max >= attack_min AS range_overlap, CASE WHEN pa >= 0.1 AND pb <= 0.25 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM b""",
        "labelled", r=_RATE10, b=_BURST,
    ),
)
def ctl1_capped(spark, sf):
    return rounded(
        controls.burst_overlap(_rated(spark, sf), "rate", by=["collection"], cap=2, high=0.1, negligible=0.25)
    )


_PRESENCE = """SELECT scenario % 4 AS platform, count(*) FILTER (rule_id IN ('5710', '5712') AND k > 97) AS n_events, count(*) AS n_benign
    FROM labelled WHERE y = 0 GROUP BY 1"""


@query(
    "ctl2_benign_event_presence",
    V.check_sql(
        "SELECT platform, n_events, n_benign, CASE WHEN n_events > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p",
        "labelled", p=_PRESENCE,
    ),
)
def ctl2(spark, sf):
    return _presence(spark, sf)


def _presence(spark, sf):
    benign = V.labelled(spark, sf).filter("y = 0").withColumn("platform", F.col("scenario") % 4)
    return controls.event_presence(benign, F.expr("rule_id IN ('5710', '5712') AND k > 97"), ["platform"])


@query(
    "ctl2_worst_case",
    V.check_sql(
        "SELECT CASE WHEN min(n_events) > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, min(n_events) AS n_events FROM p",
        "labelled", p=_PRESENCE,
    ),
)
def ctl2_worst(spark, sf):
    return controls.worst_case(_presence(spark, sf))


_SHARES = """SELECT collection, rule_id, a * 1.0 / sum(a) OVER (PARTITION BY collection) AS sa, b * 1.0 / sum(b) OVER (PARTITION BY collection) AS sb
    FROM (SELECT collection, rule_id, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM labelled GROUP BY 1, 2)"""


def _c3_sql(negligible: str) -> str:
    return f"""SELECT c.collection, coalesce(w.rule_id, 'None') AS dominant_rule, round(coalesce(w.sa, 0), 6) AS attack_share,
      round(coalesce(w.sb, 0), 6) AS benign_share, CASE WHEN w.rule_id IS NULL THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM (SELECT DISTINCT collection FROM shares) c LEFT JOIN (SELECT * FROM shares
      WHERE ((sa > 0.5 AND sb <= {negligible}) OR (sb > 0.5 AND sa <= {negligible})) AND sa > 0
      QUALIFY row_number() OVER (PARTITION BY collection ORDER BY sa DESC) = 1) w USING (collection)"""


@query("ctl3_rule_composition", V.check_sql(_c3_sql("0.08"), "labelled", shares=_SHARES))
def ctl3(spark, sf):
    return rounded(
        controls.rule_composition(V.labelled(spark, sf), "rule_id", by=["collection"], negligible=0.08)
    )


_WIDE, _NARROW = ("level", "auth_failure", "kw_scan", "kw_brute", "k", "hour"), ("level", "auth_failure", "kw_scan", "kw_brute")
_SPLITS = {"temporal": _EARLY, "random 42": _drawn(42), "random 7": _drawn(7)}
#: The settings of CTL4: every split with two sets of columns.
_SETTINGS = {
    f"{split}, {len(columns)} columns": models.Fit(f"{split}, {len(columns)} columns", columns, split, trees=3, depth=1, bins=128, subsample=1.0)
    for split in _SPLITS for columns in (_WIDE, _NARROW)
}


def _settings_sql():
    """Scores of every setting, its best F1 on the grid, and the F1 of the lookup on the same split."""
    parts, rows = {}, []
    for i, (name, fit) in enumerate(_SETTINGS.items()):
        parts |= _stumps_sql(fit, f"m{i}_", _SPLITS[fit.split])
        rows.append(f"SELECT '{name}' AS setting, *  FROM m{i}_out")
    parts["scored"] = " UNION ALL ".join(rows)
    parts["grid"] = f"SELECT unnest([{', '.join(map(repr, models.GRID))}]) AS t"
    parts["best"] = """SELECT setting, max(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1 FROM (
        SELECT setting, t, count(*) FILTER (y = 1 AND score >= t) AS tp, count(*) FILTER (y = 0 AND score >= t) AS fp,
          count(*) FILTER (y = 1 AND score < t) AS fn FROM scored, grid WHERE NOT train GROUP BY 1, 2) GROUP BY 1"""
    parts["looked"] = """SELECT setting, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS lookup_f1 FROM (
        SELECT s.setting, count(*) FILTER (y = 1 AND p) AS tp, count(*) FILTER (y = 0 AND p) AS fp, count(*) FILTER (y = 1 AND NOT p) AS fn
        FROM (SELECT s.setting, s.y, coalesce(l.p, false) AS p FROM (SELECT * FROM scored WHERE NOT train) s LEFT JOIN (
          SELECT setting, rule_id, 2 * sum(y) >= count(*) AS p FROM scored WHERE train GROUP BY 1, 2) l
          ON l.setting = s.setting AND l.rule_id IS NOT DISTINCT FROM s.rule_id) s GROUP BY 1)"""
    parts["judged"] = """SELECT setting, f1, lookup_f1, CASE WHEN abs(f1 - lookup_f1) < 0.01 THEN 'gap survives' ELSE 'gap closes' END AS v
        FROM best JOIN looked USING (setting)"""
    parts["stable"] = "SELECT CASE WHEN count(DISTINCT v) = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM judged"
    return parts


def _fit_and_score(rows):
    """CTL4's fit: all settings as one job, each against the signature lookup of its split."""
    rows = _with_hour(rows)

    def run(settings):
        cut = {"temporal": splits.temporal_split(rows, "us", "row_id")}
        cut |= {f"random {seed}": splits.stratified_split(rows, "y", "row_id", seed=seed) for seed in (42, 7)}
        trains, tests = ({k: v.filter(f"split = '{part}'") for k, v in cut.items()} for part in ("train", "test"))
        fits = list(settings.values())
        fitted, fills = models.fit_many(trains, fits)
        found = models.best_f1(models.score_many(tests, fits, fitted, fills)).select(F.col("fit").alias("setting"), "split", "f1")
        looked = reduce(
            DataFrame.unionByName,
            [
                audit.lookup_vs_trivial(trains[k], tests[k], "rule_id").select(F.lit(k).alias("split"), F.col("f1").alias("lookup_f1"))
                for k in dict.fromkeys(f.split for f in fits)
            ],
        )
        return found.join(looked, "split").withColumn("judged", controls.gap_verdict(F.col("f1"), F.col("lookup_f1")))

    return run


@query(
    "ctl4_verdict_stability",
    V.check_sql(
        "SELECT setting, round(f1, 6) AS f1, round(lookup_f1, 6) AS lookup_f1, v AS judged, verdict FROM judged, stable",
        "labelled", **_settings_sql(),
    ),
)
def ctl4(spark, sf):
    runs = staged(controls.run_settings(_SETTINGS, _fit_and_score(V.labelled(spark, sf, stage=True))))
    verdict = controls.verdict_stability(runs, "judged").select("verdict").scalar()
    return rounded(runs.select("setting", "f1", "lookup_f1", "judged", verdict.alias("verdict")))


_TEMPO = """SELECT collection, max(mean_rate) FILTER (y = 1) / max(mean_rate) FILTER (y = 0) AS mr, max(peak) FILTER (y = 1) / max(peak) FILTER (y = 0) AS pr
    FROM (SELECT collection, y, count(*) / ((max(us) - min(us)) / 1000000.0) AS mean_rate, max(n) / 10.0 AS peak FROM (SELECT collection, y, us,
      count(*) OVER (PARTITION BY collection, y ORDER BY us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) AS n FROM labelled) GROUP BY 1, 2) GROUP BY 1"""


@query(
    "ctl5_capture_tempo",
    V.check_sql(
        """SELECT collection, round(mr, 6) AS mean_ratio, round(pr, 6) AS peak_ratio, mr >= 2 OR mr <= 0.5 OR pr >= 2 OR pr <= 0.5 AS flagged FROM t""",
        "labelled", t=_TEMPO,
    ),
)
def ctl5(spark, sf):
    return rounded(controls.capture_tempo(V.labelled(spark, sf), "us", "row_id", by=["collection"]))


_CLAIMS = """SELECT doc_id AS claim_id, CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN source || '; src999 ;' WHEN 2 THEN NULL
    WHEN 3 THEN ' ; ' ELSE source || ' ;' || lang END AS source_file FROM {0}"""
_REGISTRY = "SELECT source AS path FROM {0} UNION SELECT lang FROM {0} WHERE lang <> 'fr'"


def _claims(spark, sf):
    docs = V.table(spark, sf, "documents")
    return spark.sql(_CLAIMS.format("{src}"), src=docs), spark.sql(_REGISTRY.format("{src}"), src=docs)


_LACK = """SELECT claim_id FROM c WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.claim_id = c.claim_id)
    UNION SELECT claim_id FROM names WHERE name NOT IN (SELECT path FROM reg)"""
_NAMES = """SELECT claim_id, trim(name) AS name FROM (SELECT claim_id, unnest(string_split(source_file, ';')) AS name FROM c)
    WHERE trim(name) <> ''"""


@query(
    "ctl6_claim_provenance",
    V.check_sql(
        """SELECT (SELECT count(*) FROM c) AS n_claims, (SELECT count(*) FROM lack) AS n_missing,
        CASE WHEN (SELECT count(*) FROM lack) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict""",
        c=_CLAIMS.format("documents"), reg=_REGISTRY.format("documents"), names=_NAMES, lack=_LACK,
    ),
)
def ctl6(spark, sf):
    return controls.claim_provenance(*_claims(spark, sf))


@query(
    "ctl6_missing_claims",
    V.check_sql(
        "SELECT claim_id FROM lack", c=_CLAIMS.format("documents"), reg=_REGISTRY.format("documents"), names=_NAMES, lack=_LACK
    ),
)
def ctl6_missing(spark, sf):
    return controls.missing_claims(*_claims(spark, sf))


@query(
    "ctl7_artifact_persistence",
    V.check_sql(
        """SELECT site, n_matches, round(cv, 6) AS gap_cv, coalesce(n >= 5 AND m > 0 AND cv <= 0.15, false) AS is_periodic,
        CASE WHEN n_matches = 0 AND NOT coalesce(n >= 5 AND m > 0 AND cv <= 0.15, false) THEN 'PASS' ELSE 'FAIL' END AS verdict
        FROM (SELECT scenario AS site, count(DISTINCT path) FILTER (k % 8 IN (0, 3, 5)) AS n_matches FROM labelled_detailed WHERE y = 0 GROUP BY 1)
        LEFT JOIN (SELECT scenario AS site, count(g) AS n, avg(g) AS m, stddev_pop(g) / avg(g) AS cv FROM (SELECT scenario,
          (us - lag(us) OVER (PARTITION BY scenario ORDER BY us, row_id)) / 1000000.0 AS g FROM labelled_detailed WHERE y = 0 AND level >= 5) GROUP BY 1)
        USING (site)""",
        "labelled_detailed",
    ),
)
def ctl7(spark, sf):
    benign = V.labelled(spark, sf, detail=True).filter("y = 0").withColumn("site", F.col("scenario"))
    return rounded(
        controls.artifact_persistence(
            benign, "path", list(C.ARTIFACT_TECHNIQUE), F.col("level") >= 5, "us", "row_id", ["site"]
        )
    )


@query(
    "set3_exact_artifact_matches",
    V.check_sql(
        "SELECT DISTINCT path FROM labelled_detailed WHERE y = 0 AND path IN (SELECT path FROM labelled_detailed WHERE y = 1)",
        "labelled_detailed",
    ),
)
def set3(spark, sf):
    l = V.labelled(spark, sf, detail=True).filter("path IS NOT NULL")
    return controls.exact_matches(l.filter("y = 0"), l.filter("y = 1"), "path")


_EXTRA = " (whole corpus)"
_EXPECT = {
    ("C1", "error"): "fail", ("C1", "view"): "pass", ("C2", "error"): "pass", ("C2", "view"): "fail", ("C3", "error"): "pass",
    ("C3", "signup"): "not applied", ("C4", "all collections"): "fail", ("C5", "error"): "not flagged", ("C5", "view"): "flagged",
    ("C6", "claims as made"): "fail", ("C6", "claims as corrected"): "n/a", ("C6", "signup"): "not applied", ("C7", "view"): "fail",
    ("C7", "signup"): "not applicable",
}
_CITED = [("C5", "view")]
_ABSENT = {k: _EXPECT[k] for k in (("C3", "signup"), ("C6", "signup"), ("C7", "signup"))}
_FAILED_LOGON = ("5710", "5712", "60122")
_CORRECTED = "claim_id % 10 > 3 AND source_file NOT LIKE '%fr'"


def _confounds(where):
    return f"""SELECT collection, max(CASE WHEN ((sa > 0.5 AND sb <= 0.01) OR (sb > 0.5 AND sa <= 0.01)) AND sa > 0 THEN 1 ELSE 0 END) AS bad FROM (
        SELECT collection, coalesce(a * 1.0 / nullif(sum(a) OVER c, 0), 0) AS sa, coalesce(b * 1.0 / nullif(sum(b) OVER c, 0), 0) AS sb FROM (
          SELECT collection, rule_id, count(*) FILTER (y = 1 AND {where}) AS a, count(*) FILTER (y = 0 AND {where}) AS b
          FROM labelled_detailed GROUP BY 1, 2) WINDOW c AS (PARTITION BY collection)) GROUP BY 1"""


def _claims_sql(where):
    lack = f"""(SELECT count(*) FROM c WHERE ({where}) AND (NOT EXISTS (SELECT 1 FROM names n WHERE n.claim_id = c.claim_id)
        OR claim_id IN (SELECT claim_id FROM names WHERE name NOT IN (SELECT path FROM reg))))"""
    return f"CASE WHEN {lack} = 0 THEN 'pass' ELSE 'fail' END"


@query(
    "ctl8_control_matrix",
    V.check_sql(
        f"""SELECT control, corpus, verdict, coalesce(expected, '-') AS expected, CASE WHEN corpus LIKE '%{_EXTRA}' THEN 'beside the table'
          WHEN control = 'C5' AND corpus = 'view' THEN 'cited' WHEN expected IS NULL THEN 'unexpected cell' WHEN expected = 'n/a' THEN 'not compared'
          WHEN expected = verdict THEN 'match' ELSE 'MISMATCH' END AS status
        FROM (SELECT * FROM cells WHERE (control, corpus) NOT IN (SELECT control, corpus FROM absent) UNION ALL SELECT * FROM absent) LEFT JOIN (VALUES """
        + ", ".join(f"('{c}', '{k}', '{v}')" for (c, k), v in _EXPECT.items())
        + ") AS e(control, corpus, expected) USING (control, corpus)",
        "labelled", "labelled_detailed", **_settings_sql(), r=_RATE10, b=_BURST, whole=_confounds("true"), pivoted=_confounds("srcuser IS NOT NULL"),
        tempo=_TEMPO, c=_CLAIMS.format("documents"), reg=_REGISTRY.format("documents"), names=_NAMES,
        c7="""SELECT collection, count(DISTINCT path) FILTER (k % 8 IN (0, 3, 5)) AS n_matches FROM labelled_detailed WHERE y = 0 GROUP BY 1""",
        beat="""SELECT collection, count(g) >= 5 AND avg(g) > 0 AND coalesce(stddev_pop(g) / nullif(avg(g), 0) <= 0.15, false) AS periodic FROM (
            SELECT collection, (us - lag(us) OVER (PARTITION BY collection ORDER BY us, row_id)) / 1000000.0 AS g
            FROM labelled_detailed WHERE y = 0 AND level >= 5) GROUP BY 1""",
        absent="SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}', '{v}')" for (c, k), v in _ABSENT.items()) + ") t(control, corpus, verdict)",
        cells=f"""SELECT 'C1' AS control, collection AS corpus, CASE WHEN benign_max >= attack_min THEN 'pass' ELSE 'fail' END AS verdict FROM b
          UNION ALL SELECT 'C2', collection, CASE WHEN count(*) FILTER (y = 0 AND rule_id IN {_FAILED_LOGON}) > 0 THEN 'pass' ELSE 'fail' END
            FROM labelled GROUP BY collection
          UNION ALL SELECT 'C3', collection, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END FROM pivoted
          UNION ALL SELECT 'C3', collection || '{_EXTRA}', CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END FROM whole
          UNION ALL SELECT 'C4', 'all collections', lower(verdict) FROM stable
          UNION ALL SELECT 'C5', collection, CASE WHEN mr >= 2 OR mr <= 0.5 OR pr >= 2 OR pr <= 0.5 THEN 'flagged' ELSE 'not flagged' END FROM tempo
          UNION ALL SELECT 'C6', 'claims as made', {_claims_sql('true')}
          UNION ALL SELECT 'C6', 'claims as corrected', {_claims_sql(_CORRECTED)}
          UNION ALL SELECT 'C7', collection, CASE WHEN n_matches = 0 AND NOT coalesce(periodic, false) THEN 'pass' ELSE 'fail' END
            FROM c7 LEFT JOIN beat USING (collection)""",
    ),
)
def ctl8(spark, sf):
    columns = ["row_id", "us", "collection", "rule_id", "level", "y", "path", "srcuser", "k", "auth_failure", "kw_scan", "kw_brute"]
    alerts = staged(V.labelled(spark, sf, detail=True).select(*columns))
    rated = trailing.trailing_count(alerts, ["collection"], "us", "row_id", 600)
    rated = trailing.trailing_count(rated, ["collection", "y"], "us", "row_id", 10, "burst")
    tested = (F.col("y") == 0) & (F.col("level") >= 5)
    spaced = rounds.with_gap(rated.withColumn("tested", tested), ["collection", "tested"], "us", "row_id")
    inventory = list(C.ARTIFACT_TECHNIQUE)
    states = controls.control_states(
        spaced.withColumn("gap_s", F.when(F.col("tested"), F.col("gap_s"))), "collection", "rule_id", "us", "rate", "burst", "gap_s",
        F.col("rule_id").isin(*_FAILED_LOGON), F.col("srcuser").isNotNull(), "path", inventory,
    )
    runs = controls.run_settings(_SETTINGS, _fit_and_score(alerts))
    claims, registry = _claims(spark, sf)
    rows = [
        controls.control_cells(states, _EXTRA, len(inventory)),
        controls.verdict_row("C4", F.lit("all collections"), controls.verdict_stability(runs, "judged")),
        controls.verdict_row("C6", F.lit("claims as made"), controls.claim_provenance(claims, registry)),
        controls.verdict_row("C6", F.lit("claims as corrected"), controls.claim_provenance(claims.filter(_CORRECTED), registry)),
    ]
    return controls.verdict_matrix(rows, _EXPECT, _CITED, _ABSENT, _EXTRA)


@query(
    "ctl9_parameter_sweep",
    V.check_sql(
        "SELECT collection, count(*) AS n_values, count(DISTINCT verdict) > 1 AS flips FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY collection",
        "labelled", shares=_SHARES, s0=_c3_sql("0.0"), s1=_c3_sql("0.01"), s2=_c3_sql("0.08"),
    ),
)
def ctl9(spark, sf):
    l = V.labelled(spark, sf, stage=True)
    return controls.sweep(
        [0.0, 0.01, 0.08],
        lambda v: controls.rule_composition(l, "rule_id", by=["collection"], negligible=v),
        ["collection"],
    )
