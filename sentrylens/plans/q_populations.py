"""Queries for predicates (FLT), set operations (SET), row joins (JN12-16), sorts and splits (SPL, PRE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.operators import audit, filters, labels, rounds, splits
from sentrylens.plans import views as V
from sentrylens.plans.q_audit import rounded
from sentrylens.plans.q_labels import _BASELINES, _HITS, _LABEL, _TIERED_LINUX, _TREE, _tree, linux_tiers
from sentrylens.plans.registry import query
from sentrylens.session import staged
from sentrylens.sources.alerts import id_set

_FROM, _TO = 1704153600000000, 1705968000000000


@query(
    "flt1_closed_time_range",
    V.check_sql(f"SELECT row_id FROM alerts WHERE us BETWEEN {_FROM} AND {_TO}", "alerts"),
)
def flt1(spark, sf):
    return V.alerts(spark, sf).filter(filters.in_range(F.col("us"), _FROM, _TO)).select("row_id")


@query(
    "flt2_high_confidence_benign",
    V.check_sql(
        """SELECT row_id FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.scenario = a.scenario
        AND a.us BETWEEN w.start_us - 3600000000 AND w.end_us + 3600000000)""",
        "windows",
    ),
)
def flt2(spark, sf):
    return filters.outside_margin(V.alerts(spark, sf), V.windows(spark, sf), ["scenario"]).select("row_id")


@query(
    "flt3_rule_family",
    V.check_sql(
        f"""SELECT CASE WHEN rule_id IN ('31101', '31151') THEN 'known'
        WHEN rule_id IN ({', '.join(f"'{r}'" for r in C.INCIDENTAL_RULES)}) THEN 'incidental'
        WHEN rule_id IN ({', '.join(f"'{r}'" for r in C.EXPECTED_TECHNIQUES)}) THEN 'discriminative' ELSE 'other' END AS family,
        count(*) AS n FROM alerts GROUP BY 1""",
        "alerts",
    ),
)
def flt3(spark, sf):
    return V.alerts(spark, sf).groupBy(filters.rule_family(F.col("rule_id")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt4_detector_split",
    V.check_sql(
        "SELECT CASE WHEN event_type = 'click' THEN 'network' ELSE 'native' END AS detector, count(*) AS n FROM alerts GROUP BY 1",
        "alerts",
    ),
)
def flt4(spark, sf):
    rule = F.when(F.col("event_type") == "click", "86601").otherwise(F.col("rule_id"))
    return V.alerts(spark, sf).groupBy(filters.detector(rule).alias("detector")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt5_exclude_warmup",
    V.check_sql(
        "SELECT row_id FROM (SELECT row_id, us, min(us) OVER (PARTITION BY scenario) AS f FROM alerts) WHERE us >= f + 43200000000",
        "alerts",
    ),
)
def flt5(spark, sf):
    return filters.exclude_warmup(V.alerts(spark, sf), "scenario", "us").select("row_id")


_TIERS = dict(baselines=_BASELINES, hits=_HITS, tiers=_TIERED_LINUX)


@query(
    "flt6_provenance_predicate",
    V.check_sql(
        f"""SELECT row_id FROM (SELECT row_id, {_LABEL} FROM tiers) WHERE label = 'attack'
        AND technique IN ('T1110.001', 'T1136.001') AND row_id IN (SELECT node FROM tree)""",
        "detailed", "windows", tree=_TREE, **_TIERS,
    ),
)
def flt6(spark, sf):
    t = labels.in_tree(linux_tiers(spark, sf), _tree(spark, sf), "row_id", "node")
    return t.filter(filters.provenance(["T1110.001", "T1136.001"])).select("row_id")


@query(
    "flt7_pivot_subset",
    V.check_sql(
        f"SELECT row_id FROM (SELECT row_id, srcuser, {_LABEL} FROM tiers) WHERE srcuser IS NOT NULL AND label <> 'uncertain'",
        "detailed", "windows", **_TIERS,
    ),
)
def flt7(spark, sf):
    return linux_tiers(spark, sf).filter(filters.pivot_subset(F.col("srcuser"))).select("row_id")


@query(
    "flt8_rule_novelty",
    V.check_sql(
        """SELECT row_id, CASE WHEN rule_id IN (SELECT rule_id FROM labelled WHERE y = 1 AND k < 2) THEN 'in_attack'
        WHEN rule_id IN (SELECT rule_id FROM labelled WHERE k < 4 AND level < 12) THEN 'in_all' ELSE 'novel' END AS novelty FROM labelled""",
        "labelled",
    ),
)
def flt8(spark, sf):
    l = V.labelled(spark, sf)
    seen = id_set(l.filter("k < 4 AND level < 12").select(F.col("rule_id").alias("value")))
    attack = id_set(l.filter("y = 1 AND k < 2").select(F.col("rule_id").alias("value")))
    return filters.rule_novelty(l, "rule_id", seen, attack).select("row_id", "novelty")


@query(
    "flt9_first_per_key",
    V.check_sql("SELECT signature, k, min(row_id) AS row_id FROM alerts GROUP BY signature, k", "alerts"),
)
def flt9(spark, sf):
    a = V.alerts(spark, sf).select("signature", "k", "row_id", "us")
    return filters.first_per_key(a, ["signature", "k"], "row_id").select("signature", "k", "row_id")


@query("srt1_event_time_order", V.check_sql("SELECT row_id, us FROM alerts ORDER BY us, row_id", "alerts"))
def srt1(spark, sf):
    return filters.by_event_time(V.alerts(spark, sf).select("row_id", "us"), "us", "row_id")


@query(
    "set1_union_of_collections",
    V.check_sql("SELECT source, count(*) AS n FROM (SELECT 'attack' AS source FROM labelled WHERE y = 1 UNION ALL SELECT 'benign' FROM labelled WHERE y = 0) GROUP BY 1", "labelled"),
)
def set1(spark, sf):
    l = V.labelled(spark, sf)
    u = filters.union_tagged({"attack": l.filter("y = 1").drop("kw_scan"), "benign": l.filter("y = 0")})
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_FOUND = "SELECT signature, count(*) AS n FROM alerts WHERE k < 60 GROUP BY 1"
_PUBLISHED = "SELECT signature, count(*) AS n FROM alerts WHERE k < 60 + level * 0 AND event_type <> 'view' OR (k < 50 AND level = 12) GROUP BY 1"


@query(
    "set2_signature_set_completeness",
    V.check_sql(
        """SELECT coalesce(f.signature, p.signature) AS signature, CASE WHEN f.n IS NULL THEN 'missing' WHEN p.n IS NULL THEN 'extra'
        WHEN f.n = p.n THEN 'match' ELSE 'volume differs' END AS status FROM found f FULL JOIN published p ON f.signature = p.signature""",
        "alerts", found=_FOUND, published=_PUBLISHED,
    ),
)
def set2(spark, sf):
    a = V.alerts(spark, sf)
    found = a.filter("k < 60").groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    published = a.filter("(k < 60 AND event_type <> 'view') OR (k < 50 AND level = 12)").groupBy("signature").agg(
        F.count(F.lit(1)).alias("n")
    )
    return filters.set_difference(found, published, "signature").select("signature", "status")


# --- joins on rows and buckets --------------------------------------------------------------


@query(
    "jn12_inherited_window_verdict",
    V.check_sql(
        """SELECT a.row_id, coalesce(w.pred, -1) AS inherited FROM alerts a LEFT JOIN (SELECT collection, us // 600000000 AS b,
        CAST(max(level) >= 8 AS INT) AS pred FROM alerts GROUP BY 1, 2 HAVING count(*) > 1) w
        ON a.collection = w.collection AND a.us // 600000000 = w.b""",
        "alerts",
    ),
)
def jn12(spark, sf):
    from sentrylens.operators.trailing import grid_windows

    a = V.alerts(spark, sf)
    w = grid_windows(a, ["collection"]).filter("alert_count > 1").withColumn("pred", (F.col("max_level") >= 8).cast("int"))
    return filters.inherit_verdict(a, w, "collection").select("row_id", F.coalesce("inherited", F.lit(-1)).alias("inherited"))


@query(
    "jn13_alignment_check",
    V.check_sql("SELECT count(*) FILTER (k <> 1) AS aligned, count(*) FILTER (k = 1) AS unaligned FROM alerts", "alerts"),
)
def jn13_check(spark, sf):
    a = V.alerts(spark, sf)
    return filters.alignment_gaps(a.select("row_id"), a.filter("k <> 1").select("row_id"), "row_id")


@query("jn13_align_by_row", V.check_sql("SELECT row_id, value, CAST(y AS BIGINT) AS y FROM labelled", "labelled"))
def jn13(spark, sf):
    l = V.labelled(spark, sf)
    return filters.align_by_row(
        V.alerts(spark, sf).select("row_id", "value"), l.select("row_id", F.col("y").cast("long").alias("y")), "row_id"
    )


@query(
    "jn15_exclude_holdout",
    V.check_sql("SELECT row_id FROM alerts WHERE NOT (k % 7 = 0 AND level = 3)", "alerts"),
)
def jn15(spark, sf):
    a = V.alerts(spark, sf)
    return splits.exclude_rows(a, a.filter("k % 7 = 0 AND level = 3"), "row_id").select("row_id")


_HALF = """SELECT collection, count(*) FILTER (y = 1 AND level >= 8) * 1.0 / count(*) FILTER (y = 1) AS recall,
    count(*) FILTER (y = 0 AND level >= 8) * 1.0 / count(*) FILTER (y = 0) AS fpr,
    2.0 * count(*) FILTER (y = 1 AND level >= 8) / (count(*) FILTER (y = 1) + count(*) FILTER (level >= 8)) AS f1
    FROM labelled WHERE k % 2 = {0} GROUP BY collection"""


@query(
    "jn16_candidate_tradeoff",
    V.check_sql(
        """SELECT g.collection, round(g.f1, 6) AS gain_f1, round(g.fpr, 6) AS gain_fpr, round(100 * (r.recall - b.recall), 6) AS recall_delta_pp,
        round(100 * (r.fpr - b.fpr), 6) AS fpr_delta_pp, round(r.f1 - b.f1, 6) AS f1_delta,
        CASE WHEN 100 * (r.recall - b.recall) < -3 THEN 'worse' WHEN 100 * (r.recall - b.recall) > 3 THEN 'better'
          ELSE 'about equal' END AS flag
        FROM gains g JOIN regressions r ON g.collection = r.collection AND r.collection <> 'view'
        JOIN regressions b ON b.collection = 'view'""",
        "labelled", gains=_HALF.format(0), regressions=_HALF.format(1),
    ),
)
def jn16(spark, sf):
    l = V.labelled(spark, sf).withColumn("pred", (F.col("level") >= 8).cast("int"))
    halves = staged(audit.confusion(l.withColumn("half", F.col("k") % 2), by=["half", "collection"]))
    gains, regressions = (halves.filter(F.col("half") == i).drop("half") for i in (0, 1))
    from sentrylens.operators.decisions import tradeoff

    return rounded(tradeoff(gains, regressions, "collection", "view"))


# --- splits ------------------------------------------------------------------------------------

_H = "CAST('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 12) AS BIGINT)"


@query(
    "spl1_stratified_split",
    V.check_sql(
        f"""SELECT row_id, CASE WHEN rn <= round_even(0.8 * n, 0) THEN 'train' ELSE 'test' END AS split FROM (SELECT row_id,
        row_number() OVER (PARTITION BY y ORDER BY {_H}, row_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM labelled)""",
        "labelled",
    ),
)
def spl1(spark, sf):
    return splits.stratified_split(V.labelled(spark, sf, stage=True), "y", "row_id").select("row_id", "split")


@query(
    "spl2_split_consistency",
    V.check_sql(
        "SELECT row_id, 'train' AS split, CAST(1 AS BIGINT) AS surplus FROM alerts WHERE k = 3 UNION ALL SELECT row_id, 'test', -1 FROM alerts WHERE k = 3",
        "alerts",
    ),
)
def spl2(spark, sf):
    a = V.alerts(spark, sf).select("row_id", F.when(F.col("k") > 2, "train").otherwise("test").alias("split"))
    b = V.alerts(spark, sf).select("row_id", F.when(F.col("k") > 3, "train").otherwise("test").alias("split"))
    return splits.split_differences(a, b, ["row_id", "split"])


@query(
    "spl3_temporal_split",
    V.check_sql(
        """SELECT row_id, CASE WHEN row_number() OVER (ORDER BY us, row_id) <= CAST(floor(0.8 * (SELECT count(*) FROM alerts)) AS BIGINT)
        THEN 'train' ELSE 'test' END AS split FROM alerts""",
        "alerts",
    ),
)
def spl3(spark, sf):
    return splits.temporal_split(V.alerts(spark, sf), "us", "row_id").select("row_id", "split")


@query(
    "spl4_class_tail_split",
    V.check_sql(
        """SELECT row_id, CASE WHEN rn > greatest(1, round_even(0.3 * n, 0)) THEN 'train' ELSE 'test' END AS split FROM (SELECT row_id,
        row_number() OVER (PARTITION BY y ORDER BY us DESC, row_id DESC) AS rn, count(*) OVER (PARTITION BY y) AS n FROM labelled)""",
        "labelled",
    ),
)
def spl4(spark, sf):
    return splits.class_tail_split(V.labelled(spark, sf, stage=True), "y", "us", "row_id").select("row_id", "split")


@query(
    "spl5_round_split",
    V.check_sql(
        """SELECT row_id, CASE WHEN round < (SELECT max(round) FROM r WHERE event_type = 'error') THEN 'train' ELSE 'test' END AS split
        FROM r WHERE event_type = 'error' UNION ALL SELECT row_id, CASE WHEN row_number() OVER (ORDER BY us, row_id)
          <= CAST(floor(0.8 * (SELECT count(*) FROM r WHERE event_type <> 'error')) AS BIGINT) THEN 'train' ELSE 'test' END
        FROM r WHERE event_type <> 'error'""",
        "alerts",
        r="""SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY us, row_id) AS round FROM (SELECT *, CASE WHEN us - lag(us) OVER (
          PARTITION BY event_type ORDER BY us, row_id) > 3600000000 THEN 1 ELSE 0 END AS opens FROM alerts)""",
    ),
)
def spl5(spark, sf):
    r = rounds.rounds(V.alerts(spark, sf), ["event_type"], "us", "row_id", gap_s=3600).withColumn(
        "y", F.col("auth_failure")
    )
    return splits.round_split(r, "y", "round", "us", "row_id").select("row_id", "split")


@query(
    "spl6_permutation_split",
    V.check_sql(
        f"""SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {_H}, row_id) <= floor(0.7 * (SELECT count(*) FROM alerts)) THEN 'train'
        ELSE 'test' END AS split FROM alerts""",
        "alerts",
    ),
)
def spl6(spark, sf):
    return splits.permutation_split(V.alerts(spark, sf), "row_id").select("row_id", "split")


@query(
    "spl7_cap_sample",
    V.check_sql(
        f"SELECT collection, row_id FROM alerts QUALIFY row_number() OVER (PARTITION BY collection ORDER BY {_H}, row_id) <= 500",
        "alerts",
    ),
)
def spl7(spark, sf):
    return splits.cap_sample(V.alerts(spark, sf), ["collection"], "row_id", 500).select("collection", "row_id")


@query(
    "spl8_upsample_minority",
    V.check_sql(
        f"""SELECT row_id, CAST(y AS BIGINT) AS y, copies FROM (SELECT row_id, y, CASE WHEN y = 0 THEN 1 ELSE b // a + CAST(rn <= b % a AS INT) END AS copies
        FROM (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {_H}, row_id) AS rn, count(*) FILTER (y = 1) OVER () AS a,
          count(*) FILTER (y = 0) OVER () AS b FROM labelled))""",
        "labelled",
    ),
)
def spl8(spark, sf):
    u = splits.upsample(V.labelled(spark, sf, stage=True), "y", "row_id")
    return u.groupBy("row_id", F.col("y").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("copies"))


@query(
    "spl9_oversample_rules",
    V.check_sql(
        "SELECT row_id, CASE WHEN rule_id IN ('5501', '31101') THEN 4 ELSE 1 END::BIGINT AS copies FROM alerts", "alerts"
    ),
)
def spl9(spark, sf):
    o = splits.oversample_rules(V.alerts(spark, sf), "rule_id", ["5501", "31101"], 4)
    return o.groupBy("row_id").agg(F.count(F.lit(1)).alias("copies"))


_ZCOLS = ("value", "level", "k2")


@query(
    "pre1_impute_and_standardise",
    V.check_sql(
        "SELECT row_id, "
        + ", ".join(
            f"round((coalesce({c}, (SELECT median({c}) FROM t WHERE k < 80)) - (SELECT avg(coalesce({c}, (SELECT median({c}) FROM t WHERE k < 80))) FROM t WHERE k < 80))"
            f" / (SELECT stddev_pop(coalesce({c}, (SELECT median({c}) FROM t WHERE k < 80))) FROM t WHERE k < 80), 6) AS {c}"
            for c in _ZCOLS
        )
        + " FROM t",
        "alerts",
        t="SELECT *, CASE WHEN k % 6 <> 0 THEN CAST(k AS DOUBLE) END AS k2 FROM alerts",
    ),
)
def pre1(spark, sf):
    a = V.alerts(spark, sf).withColumn("k2", F.when(F.col("k") % 6 != 0, F.col("k").cast("double")))
    scaler = splits.fit_scaler(a.filter("k < 80"), _ZCOLS)
    return rounded(a.select("row_id", *[z.alias(c) for c, z in splits.scaled(_ZCOLS, scaler).items()]))


@query(
    "agg42_signature_distribution",
    V.check_sql(
        """SELECT signature, count(*) FILTER (tr AND y = 1) AS train_attack, count(*) FILTER (tr AND y = 0) AS train_benign,
        count(*) FILTER (NOT tr AND y = 1) AS test_attack, count(*) FILTER (NOT tr AND y = 0) AS test_benign,
        CASE WHEN count(*) FILTER (tr) = 0 THEN 0 WHEN count(*) FILTER (tr AND y = 1) >= count(*) FILTER (tr AND y = 0) THEN 1 ELSE 0 END::BIGINT AS lookup,
        count(*) FILTER (tr) = 0 AS unseen_in_train FROM (SELECT *, level < 12 OR k < 50 AS tr FROM (
          SELECT * REPLACE (signature || '_' || CAST(k AS VARCHAR) AS signature) FROM labelled)) GROUP BY signature""",
        "labelled",
    ),
)
def agg42(spark, sf):
    return _distribution(spark, sf).withColumn("lookup", F.col("lookup").cast("long"))


def _distribution(spark, sf):
    l = V.labelled(spark, sf).withColumn("signature", F.concat_ws("_", "signature", "k"))
    train = F.expr("level < 12 OR k < 50")
    return audit.signature_distribution(l.filter(train), l.filter(~train), "signature")


@query(
    "agg42_unseen_share",
    V.check_sql(
        """SELECT count(*) FILTER (u) AS unseen_signatures, CAST(coalesce(sum(n) FILTER (u), 0) AS BIGINT) AS unseen_rows,
        round(100.0 * coalesce(sum(n) FILTER (u), 0) / sum(n), 6) AS unseen_pct FROM (SELECT signature, k, bool_and(level = 12 AND k >= 50) AS u,
          count(*) FILTER (level = 12 AND k >= 50) AS n FROM labelled GROUP BY 1, 2)""",
        "labelled",
    ),
)
def agg42_unseen(spark, sf):
    return rounded(audit.unseen_share(_distribution(spark, sf)))


@query(
    "agg42_top_attack_contributors",
    V.check_sql(
        """SELECT signature, count(*) FILTER (y = 1) AS train_attack, CASE WHEN 2 * sum(y) >= count(*) THEN 1 ELSE 0 END::BIGINT AS lookup
        FROM (SELECT *, signature || '_' || CAST(k AS VARCHAR) AS sig FROM labelled WHERE level < 12 OR k < 50) GROUP BY sig
        ORDER BY 2 DESC, 1 LIMIT 10""".replace("SELECT signature, count", "SELECT sig AS signature, count"),
        "labelled",
    ),
)
def agg42_top(spark, sf):
    top = _distribution(spark, sf).orderBy(F.col("train_attack").desc(), "signature").limit(10)
    return top.select("signature", "train_attack", F.col("lookup").cast("long").alias("lookup"))
