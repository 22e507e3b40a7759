"""Queries for histories, trailing frames and rounds (WIN) and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylens.functions import flags
from sentrylens.operators import history, rounds, trailing
from sentrylens.plans import views as V
from sentrylens.plans.registry import query

_HISTORY = (
    "alert_rate_1min", "failed_login_5min", "unique_src_ip_10min", "high_sev_ratio_20",
    "rule_diversity_10min", "time_since_last_high", "scan_preceded", "brute_preceded",
)


def _history_sql(key: str) -> str:
    """Last twenty rows by self join on the row rank: independent of list functions."""
    return f"""
    SELECT c.row_id,
      CAST(count(*) FILTER (c.us - p.us <= 60000000) AS DOUBLE) AS alert_rate_1min,
      CAST(count(*) FILTER (c.us - p.us <= 300000000 AND p.auth_failure = 1) AS DOUBLE) AS failed_login_5min,
      CAST(count(DISTINCT p.srcip) FILTER (c.us - p.us <= 600000000) AS DOUBLE) AS unique_src_ip_10min,
      round(coalesce(count(*) FILTER (p.level >= 8) * 1.0 / nullif(count(p.us), 0), 0), 6) AS high_sev_ratio_20,
      CAST(count(DISTINCT p.rule_id) FILTER (c.us - p.us <= 600000000) AS DOUBLE) AS rule_diversity_10min,
      round(coalesce(min(c.us - p.us) FILTER (p.level >= 10) / 1000000.0, 999.0), 6) AS time_since_last_high,
      CAST(coalesce(max(p.kw_scan) FILTER (c.us - p.us <= 600000000), 0) AS DOUBLE) AS scan_preceded,
      CAST(coalesce(max(p.kw_brute) FILTER (c.us - p.us <= 600000000), 0) AS DOUBLE) AS brute_preceded
    FROM numbered c LEFT JOIN numbered p
      ON c.{key} = p.{key} AND p.rn BETWEEN c.rn - 20 AND c.rn - 1
    GROUP BY c.row_id"""


_NUMBERED = (
    "SELECT *, '10.0.0.' || CAST(k AS VARCHAR) AS srcip, row_number() OVER (PARTITION BY {0} ORDER BY us, row_id)"
    " AS rn FROM alerts"
)


def _history(spark, sf, key):
    a = V.alerts(spark, sf).withColumn("srcip", F.concat(F.lit("10.0.0."), "k"))
    item = history.history_item(
        *[F.col(c) for c in ("us", "level", "rule_id", "srcip", "auth_failure", "kw_scan", "kw_brute")]
    )
    h = history.agent_history(a, [key], ["us", "row_id"], "us", item)
    return h.select("row_id", *[F.round(c, 6).alias(c) for c in _HISTORY])


@query(
    "win1_agent_history",
    V.check_sql(_history_sql("scenario"), "alerts", numbered=_NUMBERED.format("scenario")),
)
def win1(spark, sf):
    return _history(spark, sf, "scenario")


@query(
    "win1_agent_history_hot_keys",
    V.check_sql(_history_sql("collection"), "alerts", numbered=_NUMBERED.format("collection")),
)
def win1_hot(spark, sf):
    return _history(spark, sf, "collection")


@query(
    "win2_capped_rate",
    V.check_sql(
        """SELECT c.row_id, count(p.us) AS rate FROM numbered c LEFT JOIN numbered p
        ON c.collection = p.collection AND p.rn BETWEEN c.rn - 20 AND c.rn - 1 AND c.us - p.us <= 60000000
        GROUP BY c.row_id""",
        "alerts",
        numbered=_NUMBERED.format("collection"),
    ),
)
def win2(spark, sf):
    return history.capped_rate(V.alerts(spark, sf), ["collection"], ["us", "row_id"], "us").select(
        "row_id", "rate"
    )


@query(
    "win3_source_history",
    V.check_sql(
        """SELECT c.row_id, CAST(count(p.us) FILTER (c.us - p.us <= 60000000) AS DOUBLE) AS alert_rate_1min,
          CAST(count(p.us) FILTER (c.us - p.us <= 600000000) AS DOUBLE) AS alerts_10min,
          round(coalesce(min(c.us - p.us) / 1000000.0, 999.0), 6) AS time_since_last_alert
        FROM timed c LEFT JOIN timed p ON c.collection = p.collection AND c.rn > p.rn AND c.rn - p.rn <= 20
        GROUP BY c.row_id
        UNION ALL SELECT row_id, 0.0, 0.0, 999.0 FROM alerts WHERE k % 10 = 0""",
        "alerts",
        timed="""SELECT *, row_number() OVER (PARTITION BY collection ORDER BY row_id) AS rn
        FROM alerts WHERE k % 10 <> 0""",
    ),
)
def win3(spark, sf):
    # a tenth of the rows lose their time
    a = V.alerts(spark, sf).withColumn("us", F.when(F.col("k") % 10 != 0, F.col("us")))
    h = history.source_history(a, ["collection"], ["row_id"], "us")
    return h.select(
        "row_id", "alert_rate_1min", "alerts_10min",
        F.round("time_since_last_alert", 6).alias("time_since_last_alert"),
    )


@query(
    "win4_trailing_count",
    V.check_sql(
        """SELECT row_id, rn - min(rn) OVER (PARTITION BY collection ORDER BY us
          RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) + 1 AS rate FROM numbered""",
        "alerts",
        numbered=_NUMBERED.format("collection"),
    ),
)
def win4(spark, sf):
    a = V.alerts(spark, sf)
    return trailing.trailing_count(a, ["collection"], "us", "row_id", 600).select("row_id", "rate")


@query(
    "win5_peak_rate_sliding",
    V.check_sql(
        """SELECT collection, max(n) / 10.0 AS peak_rate FROM (SELECT collection, count(*) OVER (
          PARTITION BY collection ORDER BY us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) AS n FROM alerts)
        GROUP BY collection""",
        "alerts",
    ),
)
def win5(spark, sf):
    return trailing.peak_rate(V.alerts(spark, sf), ["collection"], "us", "row_id")


@query(
    "win6_mean_rate",
    V.check_sql(
        """SELECT collection, count(*) AS n, round((max(us) - min(us)) / 1000000.0, 6) AS span_s,
        round(count(*) / ((max(us) - min(us)) / 1000000.0), 9) AS mean_rate FROM alerts GROUP BY collection""",
        "alerts",
    ),
)
def win6(spark, sf):
    m = trailing.mean_rate(V.alerts(spark, sf), ["collection"], "us")
    return m.select("collection", "n", F.round("span_s", 6).alias("span_s"), F.round("mean_rate", 9).alias("mean_rate"))


@query(
    "win7_tumbling_bins",
    V.check_sql(
        """SELECT scenario, max(n) AS peak, count(*) AS used_bins, median(n) AS median_nonzero FROM (
          SELECT scenario, (us - first) // 10000000 AS bin, count(*) AS n
          FROM (SELECT *, min(us) OVER (PARTITION BY scenario) AS first FROM alerts) GROUP BY 1, 2)
        GROUP BY scenario""",
        "alerts",
    ),
)
def win7(spark, sf):
    return trailing.bin_rates(V.alerts(spark, sf), ["scenario"], "us")


def _entities(spark, sf):
    d = V.detailed_alerts(spark, sf)
    e = flags.event_flags(F.col("rule_id"))
    return d.select(
        "row_id", "us", "collection", "srcuser", "rule_id", "url", "level", "scenario",
        flags.fim_path_class(F.col("path")).alias("path_class"),
        *[c.alias(n) for n, c in e.items()],
    ).withColumn("site", F.col("scenario") % 3)


_ENTITIES = """SELECT row_id, us, scenario % 3 AS site, srcuser, rule_id, url, level,
    CASE WHEN event_type = 'view' THEN CASE k % 8 WHEN 0 THEN 'cron' WHEN 1 THEN 'cron' WHEN 2 THEN 'account_mgmt'
      WHEN 3 THEN 'ssh_key' WHEN 4 THEN 'systemd' WHEN 5 THEN 'shell_rc' WHEN 6 THEN 'shell_rc' ELSE 'other' END END
      AS path_class,
    CAST(rule_id IN ('31101', '31151', '31104', '31516') AS INT) AS is_web_scan,
    CAST(rule_id IN ('5710', '5712', '5503', '60122', '60204') AS INT) AS is_auth_fail,
    CAST(rule_id IN ('5501', '60106') AS INT) AS is_auth_success,
    CAST(rule_id IN ('5901', '5902', '5903') AS INT) AS is_account_mgmt
    FROM detailed"""


def _entity_sql(keys: str, span: int, where: str = "TRUE") -> str:
    w = f"(PARTITION BY {keys} ORDER BY us RANGE BETWEEN {span} PRECEDING AND 1 PRECEDING)"
    same = " AND ".join(f"c.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    return f"""
    SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.row_id, count(p.row_id) AS alert_count,
      coalesce(max(p.rate10), 0) * 1.0 AS max_rate_10s,
      round(CASE WHEN count(p.row_id) > 1 THEN (max(p.us) - min(p.us)) / 1000000.0 / (count(p.row_id) - 1)
            ELSE 9999.0 END, 9) AS mean_gap_s,
      round(coalesce(min(CASE WHEN p.prev >= c.us - {span} THEN p.us - p.prev END) / 1000000.0, 9999.0), 9) AS min_gap_s,
      count(DISTINCT p.rule_id) AS distinct_rule_count, count(DISTINCT p.url) AS distinct_url_count,
      round(CASE WHEN count(p.url) > 0 THEN 1 - count(DISTINCT p.url) * 1.0 / count(p.url) ELSE 0 END, 9)
        AS path_repetition_ratio,
      count(DISTINCT p.path_class) AS distinct_path_class_count,
      CAST(coalesce(sum(p.is_auth_fail), 0) AS BIGINT) AS auth_failure_count,
      CAST(coalesce(min(CASE WHEN p.is_auth_fail = 1 THEN p.us END) < max(CASE WHEN p.is_auth_success = 1 THEN p.us END),
        false) AS BIGINT) AS success_after_failure,
      {', '.join(f"count(*) FILTER (p.path_class = '{c}') AS fim_{c}_count" for c in trailing.FIM_CLASSES)}
    FROM paced c LEFT JOIN paced p ON {same} AND p.us BETWEEN c.us - {span} AND c.us - 1
    WHERE {where} GROUP BY ALL"""


def _paced(keys: str) -> str:
    return f"""SELECT *, lag(us) OVER (PARTITION BY {keys} ORDER BY us, row_id) AS prev,
      rn - min(rn) OVER (PARTITION BY {keys} ORDER BY us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) + 1 AS rate10
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY us, row_id) AS rn FROM entities)"""


def _rounded(df):
    return df.withColumns(
        {c: F.round(c, 9) for c in ("mean_gap_s", "min_gap_s", "path_repetition_ratio", "max_rate_10s")}
    )


@query(
    "win8_entity_window_global_5min",
    V.check_sql(_entity_sql("site", 300_000_000), "detailed", entities=_ENTITIES, paced=_paced("site")),
)
def win8_global_short(spark, sf):
    return _rounded(trailing.entity_window(_entities(spark, sf), ["site"], 300))


@query(
    "win8_entity_window_global_60min",
    V.check_sql(_entity_sql("site", 3_600_000_000), "detailed", entities=_ENTITIES, paced=_paced("site")),
)
def win8_global_long(spark, sf):
    return _rounded(trailing.entity_window(_entities(spark, sf), ["site"], 3600))


@query(
    "win8_entity_window_user_60min",
    V.check_sql(
        _entity_sql("site, srcuser", 3_600_000_000, "c.srcuser IS NOT NULL"),
        "detailed",
        entities=_ENTITIES,
        paced=_paced("site, srcuser"),
    ),
)
def win8_user(spark, sf):
    e = _entities(spark, sf).filter("srcuser IS NOT NULL")
    return _rounded(trailing.entity_window(e, ["site", "srcuser"], 3600))


@query(
    "win9_stage_flags",
    V.check_sql(
        """SELECT c.row_id,
          CAST((c.is_auth_fail + c.is_auth_success > 0) AND coalesce(max(p.is_web_scan), 0) = 1 AS BIGINT) AS auth_after_webscan,
          CAST(c.path_class IS NOT NULL AND coalesce(max(p.is_auth_success), 0) = 1 AS BIGINT) AS filechange_after_login,
          CAST(c.is_account_mgmt = 1 AND coalesce(max(greatest(p.is_auth_fail, p.is_auth_success)), 0) = 1 AS BIGINT)
            AS acctmgmt_after_auth
        FROM entities c LEFT JOIN entities p ON c.site = p.site AND p.us BETWEEN c.us - 3600000000 AND c.us - 1
          AND (c.srcuser IS NULL OR c.srcuser = p.srcuser)
        GROUP BY c.row_id, c.is_auth_fail, c.is_auth_success, c.path_class, c.is_account_mgmt""",
        "detailed",
        entities=_ENTITIES,
    ),
)
def win9(spark, sf):
    f = trailing.stage_flags(_entities(spark, sf), ["site"], "srcuser")
    return f.select("row_id", "auth_after_webscan", "filechange_after_login", "acctmgmt_after_auth")


@query(
    "win10_entity_novelty",
    V.check_sql(
        """SELECT row_id,
          round(coalesce((us - min(us) OVER w) / 1000000.0, 9999.0), 6) AS since_first_seen_s,
          round(coalesce((us - lag(us) OVER (PARTITION BY scenario ORDER BY us, row_id)) / 1000000.0, 9999.0), 6)
            AS since_last_alert_s
        FROM alerts WINDOW w AS (PARTITION BY scenario ORDER BY us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "alerts",
    ),
)
def win10(spark, sf):
    n = trailing.entity_novelty(V.alerts(spark, sf), ["scenario"])
    return n.select(
        "row_id", F.round("since_first_seen_s", 6).alias("since_first_seen_s"),
        F.round("since_last_alert_s", 6).alias("since_last_alert_s"),
    )


@query(
    "win11_success_after_failure",
    V.check_sql(
        """SELECT c.row_id, CAST(coalesce(min(CASE WHEN p.is_auth_fail = 1 THEN p.us END)
          < max(CASE WHEN p.is_auth_success = 1 THEN p.us END), false) AS BIGINT) AS success_after_failure
        FROM entities c LEFT JOIN entities p ON c.site = p.site AND p.us BETWEEN c.us - 3600000000 AND c.us - 1
        GROUP BY c.row_id""",
        "detailed",
        entities=_ENTITIES,
    ),
)
def win11(spark, sf):
    e = _entities(spark, sf).select(
        "row_id", "us", "site", F.col("is_auth_fail").cast("long").alias("fail"),
        F.col("is_auth_success").cast("long").alias("ok"),
    )
    return trailing.success_after_failure(e, ["site"], "us", "row_id", "fail", "ok", 3600).select(
        "row_id", "success_after_failure"
    )


@query(
    "win12_grid_windows",
    V.check_sql(
        """SELECT collection, (us // 600000000) * 600 AS bucket_s, count(*) AS alert_count,
        count(DISTINCT rule_id) AS distinct_rules, max(level) AS max_level FROM alerts GROUP BY 1, 2""",
        "alerts",
    ),
)
def win12(spark, sf):
    return trailing.grid_windows(V.alerts(spark, sf), ["collection"])


@query(
    "win13_rounds",
    V.check_sql(
        """SELECT collection, round, count(*) AS size FROM (SELECT collection, CAST(sum(opens) OVER (PARTITION BY collection
          ORDER BY us, row_id) AS BIGINT) AS round FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY collection
          ORDER BY us, row_id) > 1800000000 THEN 1 ELSE 0 END AS opens FROM alerts)) GROUP BY 1, 2""",
        "alerts",
    ),
)
def win13(spark, sf):
    r = rounds.rounds(V.alerts(spark, sf), ["collection"], "us", "row_id", gap_s=1800)
    return r.groupBy("collection", "round").agg(F.count(F.lit(1)).alias("size"))


@query(
    "win14_periodicity",
    V.check_sql(
        """SELECT scenario, n_gaps, round(mean_gap, 6) AS mean_gap_s, round(gap_sd / mean_gap, 6) AS gap_cv,
          n_gaps >= 5 AND mean_gap > 0 AND gap_sd / mean_gap <= 0.8 AS is_periodic
        FROM (SELECT scenario, count(g) AS n_gaps, avg(g) AS mean_gap, stddev_pop(g) AS gap_sd
          FROM (SELECT scenario, (us - lag(us) OVER (PARTITION BY scenario ORDER BY us, row_id)) / 1000000.0 AS g
            FROM alerts) GROUP BY scenario)""",
        "alerts",
    ),
)
def win14(spark, sf):
    p = rounds.periodicity(V.alerts(spark, sf), ["scenario"], "us", "row_id", cv=0.8)
    return p.select(
        "scenario", "n_gaps", F.round("mean_gap_s", 6).alias("mean_gap_s"),
        F.round("gap_cv", 6).alias("gap_cv"), "is_periodic",
    )
