"""Queries for feature rows (PRJ14/18/19), sources (SRC), sinks (SNK) and streams (STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.operators import audit, decisions, features
from sentrylens.plans import q_projections as P
from sentrylens.plans import q_windows as W
from sentrylens.plans import views as V
from sentrylens.plans.q_audit import rounded
from sentrylens.plans.registry import query
from sentrylens.session import files_of, staged, table_dir
from sentrylens.sources import alerts as S
from sentrylens.sources import sinks
from sentrylens.streaming import history_stream

_KW = ", ".join(f"CAST(contains(text, '{w}') AS DOUBLE) AS kw_{w}_f" for w in C.KEYWORDS)
_PROJ = f"""SELECT *, {P._STAGE.format('tactic')} AS stage FROM (SELECT *, {_KW}, {P._TACTIC} AS tactic, {P._AUTH} AS auth_f,
    {P._WEB} AS web_f, {P._CRIT} AS crit_f FROM (SELECT *, {P._TEXT} AS text FROM detailed))"""
_NUMBERED = """SELECT * REPLACE (CAST(auth_f AS INT) AS auth_failure, CAST(kw_scan_f AS INT) AS kw_scan, CAST(kw_brute_f AS INT) AS kw_brute),
    row_number() OVER (PARTITION BY scenario ORDER BY us, row_id) AS rn FROM proj"""


def _flat(spark, sf):
    return V.detailed_alerts(spark, sf).withColumn("message", F.lit(None).cast("string"))


_ROW26 = f"""SELECT row_id, CAST(length(description) AS DOUBLE) AS desc_len, CAST(level AS DOUBLE) AS rule_level,
    {', '.join(f'kw_{w}_f AS kw_{w}' for w in C.KEYWORDS)}, tactic AS mitre_tactic_id, auth_f AS is_auth_failure,
    web_f AS is_web_attack, CAST(rule_id AS DOUBLE) AS rule_id_encoded, CAST(crit_f AS DOUBLE) AS agent_criticality,
    {', '.join('h.' + f for f in features.HISTORY_FEATURES)}, CAST(stage AS DOUBLE) AS kill_chain_stage
    FROM proj JOIN hist h USING (row_id)"""
_FEATURE_VIEWS = dict(proj=_PROJ, numbered=_NUMBERED, hist=W._history_sql("scenario"))


@query("prj14_feature_row_26", V.check_sql(_ROW26, "detailed", **_FEATURE_VIEWS))
def prj14(spark, sf):
    return rounded(features.features_v2(_flat(spark, sf), ["scenario"], ["us", "row_id"], "us", keep=["row_id"]))


# Counterfactuals on the real blocks of the 26 features: attack and benign rows, hit by the distance score.
_THETA26 = 40.0
_CHAIN = (("temporal", C.TEMPORAL_BLOCK), ("content", C.CONTENT_BLOCK), ("identity", C.IDENTITY_BLOCK))


def _hits26(values: dict[str, str]) -> str:
    terms = " + ".join(f"power(({values.get(c, c)} - m_{c}) / d_{c}, 2)" for c in C.FEATURES)
    return f"count(*) FILTER ({terms} >= {_THETA26})"


def _null_sql(columns) -> dict[str, str]:
    return {c: "999.0" if c == "time_since_last_high" else "0.0" for c in columns}


def _chain_sql() -> dict[str, dict[str, str]]:
    out, taken = {}, {}
    for name, columns in _CHAIN:
        taken = taken | {c: f"q_{c}" for c in columns}
        out[name] = taken
    return out


def _blocks_check(variants: dict[str, dict[str, str]]) -> str:
    numbers = ", ".join(
        f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS d_{c}, quantile_cont({c}, 0.5) AS q_{c}" for c in C.FEATURES
    )
    return V.check_sql(
        f"""SELECT y, count(*) AS n, {_hits26({})} AS hits_original,
        {', '.join(f'{_hits26(v)} AS hits_{name}' for name, v in variants.items())} FROM rows26, benign GROUP BY y""",
        "labelled", "detailed", **_FEATURE_VIEWS, row26=_ROW26,
        rows26=f"SELECT CAST(l.y AS INT) AS y, {', '.join(f'round(r.{c}, 6) AS {c}' for c in C.FEATURES)} FROM row26 r JOIN labelled l USING (row_id)",
        benign=f"SELECT {numbers} FROM rows26 WHERE y = 0",
    )


def _blocks(spark, sf, variants):
    rows = rounded(features.features_v2(_flat(spark, sf), ["scenario"], ["us", "row_id"], "us", keep=["row_id"]))
    y = V.labelled(spark, sf).select(F.col("row_id").alias("_row"), F.col("y").cast("int").alias("y"))
    rows = staged(rows.join(y, F.col("row_id") == F.col("_row")).drop("_row"))
    benign = rows.filter("y = 0")
    return decisions.swap_recalls(
        rows, variants(benign), C.FEATURES, decisions.fit_distance(benign, C.FEATURES), _THETA26, ["y"]
    )


@query("cfx2_zeroed_blocks_26", _blocks_check({name: _null_sql(columns) for name, columns in _CHAIN}))
def cfx2_blocks(spark, sf):
    return _blocks(spark, sf, lambda _: {name: decisions.null_values(columns) for name, columns in _CHAIN})


@query("cfx4_block_chain_26", _blocks_check(_chain_sql()))
def cfx4_blocks(spark, sf):
    return _blocks(spark, sf, lambda benign: decisions.block_chain(decisions.medians_of(benign, C.FEATURES), _CHAIN))


@query(
    "prj18_feature_row_22",
    V.check_sql(
        f"""SELECT row_id, round(level / 15.0, 6) AS severity_norm, tactic AS mitre_tactic_id, {P._NAUTH} AS is_auth_failure,
        {P._NWEB} AS is_web_attack, {P._NCRIT} AS agent_criticality,
        {', '.join('h.' + f for f in features.HISTORY_FEATURES if f != 'time_since_last_high')},
        CASE WHEN h.time_since_last_high = 0 THEN 999.0 ELSE h.time_since_last_high END AS time_since_last_high,
        0.0::DOUBLE AS kill_chain_stage, {', '.join(f'{P.class_sql(i)} AS {n}' for i, n in enumerate(P._CLASS_NAMES))},
        {P._text_features_sql(P._RULE_TEXT)}, 0.0::DOUBLE AS process_depth
        FROM proj JOIN hist h USING (row_id)""",
        "detailed", **_FEATURE_VIEWS,
    ),
)
def prj18(spark, sf):
    return rounded(features.features_norm(_flat(spark, sf), ["scenario"], ["us", "row_id"], "us", keep=["row_id"]))


@query(
    "prj19_map_26_to_22",
    V.check_sql(
        f"""SELECT row_id, round(level / 15.0, 6) AS severity_norm, tactic AS mitre_tactic_id, auth_f AS is_auth_failure,
        web_f AS is_web_attack, CAST(crit_f AS DOUBLE) AS agent_criticality, {', '.join('h.' + f for f in features.HISTORY_FEATURES)},
        CAST(stage AS DOUBLE) AS kill_chain_stage,
        CAST(CASE WHEN web_f > 0 THEN 3 WHEN auth_f > 0 THEN 0 WHEN kw_root_f + kw_privilege_f > 0 THEN 4 WHEN kw_shell_f > 0 THEN 1
          ELSE 5 END AS DOUBLE) AS event_category,
        CAST(CASE WHEN kw_shell_f > 0 THEN 0 WHEN kw_brute_f > 0 THEN 2 WHEN auth_f > 0 THEN 2 ELSE 5 END AS DOUBLE) AS event_type,
        CAST(CASE WHEN auth_f > 0 THEN 1 WHEN kw_denied_f > 0 THEN 2 ELSE 3 END AS DOUBLE) AS event_outcome,
        CAST(CASE WHEN kw_root_f + kw_privilege_f > 0 THEN 3 ELSE 0 END AS DOUBLE) AS actor_type,
        0.0::DOUBLE AS touches_sensitive_path, 0.0::DOUBLE AS is_suid_check, kw_root_f + kw_privilege_f AS cmdline_priv_tokens,
        0.0::DOUBLE AS process_depth FROM proj JOIN hist h USING (row_id)""",
        "detailed", **_FEATURE_VIEWS,
    ),
)
def prj19(spark, sf):
    rows = features.features_v2(_flat(spark, sf), ["scenario"], ["us", "row_id"], "us", keep=["row_id"])
    return rounded(features.v2_to_norm(rows, ["row_id"]))


@query(
    "agg38_feature_taxonomy",
    V.check_sql(
        """SELECT CASE WHEN feature IN ('desc_len', 'rule_level', 'rule_id_encoded') THEN 'identity'
          WHEN feature IN ('alert_rate_1min', 'unique_src_ip_10min', 'time_since_last_high') THEN 'behavioural' ELSE 'correlated' END AS bucket,
        count(DISTINCT feature) AS n_features, count(*) FILTER (value <> 0) AS n_nonzero
        FROM (UNPIVOT row26 ON COLUMNS(* EXCLUDE (row_id)) INTO NAME feature VALUE value) GROUP BY 1""",
        "detailed", **_FEATURE_VIEWS, row26=_ROW26,
    ),
)
def agg38(spark, sf):
    rows = features.features_v2(_flat(spark, sf), ["scenario"], ["us", "row_id"], "us")
    return audit.feature_taxonomy(audit.stacked(rows, C.FEATURES))


# --- sources: the alerts are first written as the JSON lines that a collector delivers --------


def _json_lines(spark, sf):
    """Alert lines of the given events: some blank, some cut off, lists also as scalars."""
    d = V.detailed_alerts(spark, sf)
    scalar_or_list = F.when(F.size("rule_groups") == 1, F.to_json(F.struct(F.col("rule_groups")[0].alias("groups")))).otherwise(
        F.to_json(F.struct(F.col("rule_groups").alias("groups")))
    )
    body = F.to_json(
        F.struct(
            F.col("alert_time").alias("timestamp"),
            F.struct(F.col("agent_name").alias("name"), F.col("scenario").cast("string").alias("id")).alias("agent"),
            F.struct("srcip", "srcuser", "command", "url").alias("data"),
            F.struct("path", F.col("fim_event").alias("event"), F.col("mtime").alias("mtime_after")).alias("syscheck"),
            "full_log",
            F.concat(F.lit("#"), "row_id").alias("location"),
        )
    )
    rule = F.concat(
        F.lit('"rule":{"id":"'), "rule_id", F.lit('","level":'), F.col("level").cast("string"), F.lit(',"description":"'),
        "description", F.lit('",'), F.regexp_replace(scalar_or_list, r"^\{|\}$", ""), F.lit("}"),
    )
    line = F.concat(F.lit("{"), rule, F.lit(","), F.expr("substring(_body, 2)"))
    whole = d.withColumn("_body", body).withColumn("_line", line)
    broken = (
        F.when(F.col("row_id") % 50 == 7, F.lit("   "))
        .when(F.col("row_id") % 50 == 11, F.expr("substring(_line, 1, length(_line) - 3)"))
        .otherwise(F.col("_line"))
    )
    return whole.select(
        "row_id", broken.alias("value"),
        F.concat(F.lit("site"), F.col("scenario") % 4, F.lit("_alerts.json")).alias("file_name"),
    )


@query(
    "src1_json_lines_scan",
    V.check_sql(
        """SELECT row_id, us // 1000000 AS ts_s, rule_id, CAST(level AS VARCHAR) AS level, description, agent_name, srcip,
        coalesce(srcuser, '-') AS srcuser, coalesce(path, '-') AS path, array_to_string(rule_groups, ',') AS groups,
        coalesce(full_log, '-') AS full_log FROM detailed WHERE row_id % 50 NOT IN (7, 11)""",
        "detailed",
    ),
)
def src1(spark, sf):
    rows = S.parse_lines(_json_lines(spark, sf), S.ALERT_SCHEMA)
    flat = S.flatten(rows, ["row_id"])
    dash = F.lit("-")
    return flat.select(
        "row_id", F.unix_seconds("ts").alias("ts_s"), "rule_id", "level", "description", "agent_name", "srcip",
        F.coalesce("srcuser", dash).alias("srcuser"), F.coalesce("path", dash).alias("path"),
        F.array_join("rule_groups", ",").alias("groups"), F.coalesce("full_log", dash).alias("full_log"),
    )


def _alert_files(spark, sf):
    """A folder of the alert lines as files ``siteN_partK_alerts.json``, as collectors leave them."""
    path = table_dir(spark)
    lines = _json_lines(spark, sf).withColumn("site", F.regexp_extract("file_name", "^(site[0-9]+)", 1))
    lines.select("value", "site").write.partitionBy("site").text(f"{path}/written")
    fs, root = files_of(spark, f"{path}/written")
    into = fs.getFileStatus(root).getPath().getParent()
    for folder in fs.listStatus(root):
        if folder.isDirectory():
            site = folder.getPath().getName().removeprefix("site=")
            parts = sorted(f.getPath().getName() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            for k, name in enumerate(parts):
                fs.rename(files_of(spark, f"{folder.getPath().toString()}/{name}")[1], files_of(spark, f"{into.toString()}/{site}_part{k}_alerts.json")[1])
    return f"{path}/*_alerts.json"


def _read_files(spark, sf):
    return S.with_scenario(S.read_alerts(spark, _alert_files(spark, sf)), "_part[0-9]+_alerts.json")


@query(
    "src2_scenario_from_file_name",
    V.check_sql(
        """SELECT 'site' || CAST(scenario % 4 AS VARCHAR) AS scenario, count(*) AS n, count(DISTINCT rule_id) AS n_rules
        FROM alerts WHERE row_id % 50 NOT IN (7, 11) GROUP BY 1""",
        "alerts",
    ),
)
def src2(spark, sf):
    rows = _read_files(spark, sf)
    return rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule.id").alias("n_rules"))


@query(
    "src3_unwrap_envelope",
    V.check_sql(
        """SELECT row_id, CASE WHEN row_id % 3 = 0 THEN us // 1000000 + 5 ELSE us // 1000000 END AS ts_s,
        CASE WHEN row_id % 3 = 0 AND row_id % 5 <> 0 THEN round(value / 500, 6) ELSE 0.0 END AS score, rule_id
        FROM alerts WHERE row_id % 50 NOT IN (7, 11)""",
        "alerts",
    ),
)
def src3(spark, sf):
    lines = _json_lines(spark, sf).withColumnRenamed("value", "line")
    both = lines.join(V.alerts(spark, sf).select("row_id", "us", "value"), "row_id")
    later = F.date_format(F.timestamp_micros(F.col("us") + 5_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    score = F.when(F.col("row_id") % 5 == 0, '"none"').otherwise(
        F.round(F.col("value") / 500, 6).cast("decimal(12,6)").cast("string")
    )
    # a third of the rows carry an envelope with a later time and a score, some of them bad
    wrapped = F.concat(
        F.lit('{"timestamp":"'), later, F.lit('","score":'), score, F.lit(',"original_alert":'), "line", F.lit("}")
    )
    text = both.select("row_id", F.when(F.col("row_id") % 3 == 0, wrapped).otherwise(F.col("line")).alias("value"))
    rows = S.unwrap(S.parse_lines(text, S.ENVELOPE_SCHEMA), ["row_id"])
    return rows.select(
        "row_id", F.unix_seconds("ts").alias("ts_s"), "score", F.col("alert.rule.id").alias("rule_id")
    )


@query(
    "src4_log_anomaly_scan",
    V.check_sql(
        """SELECT row_id, CASE WHEN k % 4 = 3 THEN -1.0 ELSE round(us // 1000000 + 0.25 * (k % 4), 6) END AS epoch,
        event_type AS signature FROM alerts""",
        "alerts",
    ),
)
def src4(spark, sf):
    a = V.alerts(spark, sf)
    second = F.floor(F.col("us") / 1_000_000)
    time = (second + 0.25 * (F.col("k") % 4)).cast("decimal(20,2)").cast("string")
    # the detection time may be missing (then the log's own time counts) or no number at all
    body = F.when(F.col("k") % 4 == 0, F.concat(F.lit('"DetectionTimestamp":['), time, F.lit(']'))).when(
        F.col("k") % 4 == 3, F.lit('"Timestamps":["n/a"]')
    ).otherwise(F.concat(F.lit('"Timestamps":['), time, F.lit(']')))
    line = F.concat(
        F.lit('{"LogData":{'), body, F.lit('},"AnalysisComponent":{"AnalysisComponentName":"'), "event_type",
        F.lit('","TrainingMode":false},"AMiner":{"ID":"m1"}}'),
    )
    rows = S.anomaly_rows(S.parse_lines(a.select("row_id", line.alias("value")), S.ANOMALY_SCHEMA), ["row_id"])
    return rows.select("row_id", F.coalesce("epoch", F.lit(-1.0)).alias("epoch"), "signature")


@query(
    "src6_marker_lines",
    V.check_sql(
        """SELECT row_id, (us // 1000000) * 1000000 AS us, CASE event_type WHEN 'error' THEN 'START' ELSE 'END' END AS kind,
        'T' || CAST(k AS VARCHAR) AS technique FROM alerts WHERE event_type IN ('error', 'signup')""",
        "alerts",
    ),
)
def src6(spark, sf):
    a = V.alerts(spark, sf)
    t = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("event_type") == "error", "START").when(F.col("event_type") == "signup", "END")
    # the other event types stand for lines that are no markers
    line = F.coalesce(
        F.concat(F.lit(">>> "), t, F.lit(" "), kind, F.lit(" | T"), F.col("k"), F.lit(" dirb webscan")),
        F.concat(F.lit("note "), "event_type"),
    )
    m = S.parse_markers(a.select("row_id", line.alias("value")))
    return m.select("row_id", "us", "kind", "technique")


def _event_xml(spark, sf):
    a = V.alerts(spark, sf)
    eid = F.when(F.col("k") % 4 == 0, "1").when(F.col("k") % 4 == 1, "11").when(F.col("k") % 4 == 2, "13").otherwise("3")

    def data(name, value):
        return F.concat(F.lit(f"<Data Name='{name}'>"), value.cast("string"), F.lit("</Data>"))

    parts = [
        F.lit("<Event><System><EventID Qualifiers=''>"), eid, F.lit("</EventID></System><EventData>"),
        data("ProcessGuid", F.col("row_id")), data("ParentProcessGuid", F.floor(F.col("row_id") / 2)),
        data("Image", F.concat(F.lit("C:\\bin\\p"), F.col("k"))),
        F.when(F.col("k") % 4 == 1, data("TargetFilename", F.concat(F.lit("f"), F.col("k")))).otherwise(F.lit("")),
        F.when(F.col("k") % 4 == 2, data("TargetObject", F.concat(F.lit("HKLM"), F.col("k")))).otherwise(F.lit("")),
        F.lit("</EventData></Event>"),
    ]
    return a.select("row_id", F.concat(*parts).alias("xml"))


@query(
    "src7_process_events",
    V.check_sql(
        """SELECT CAST(row_id AS VARCHAR) AS process_guid, CAST(row_id // 2 AS VARCHAR) AS parent_guid,
        'C:\\bin\\p' || CAST(k AS VARCHAR) AS image FROM alerts WHERE k % 4 = 0""",
        "alerts",
    ),
)
def src7(spark, sf):
    return S.process_events(_event_xml(spark, sf))[0].select("process_guid", "parent_guid", "image")


@query(
    "src7_artifact_events",
    V.check_sql(
        """SELECT CASE k % 4 WHEN 1 THEN '11' ELSE '13' END AS eid, CAST(row_id AS VARCHAR) AS process_guid,
        CASE k % 4 WHEN 1 THEN 'f' ELSE 'HKLM' END || CAST(k AS VARCHAR) AS target FROM alerts WHERE k % 4 IN (1, 2)""",
        "alerts",
    ),
)
def src7_artifacts(spark, sf):
    return S.process_events(_event_xml(spark, sf))[1].select("eid", "process_guid", "target")


@query(
    "src9_id_set",
    V.check_sql("SELECT DISTINCT signature AS id FROM alerts WHERE k % 10 <> 0", "alerts"),
)
def src9(spark, sf):
    padded = F.when(F.col("k") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "signature", F.lit(" ")))
    return S.id_set(V.alerts(spark, sf).select(padded.alias("value")))


@query("snk1_write_and_read_table", V.check_sql("SELECT row_id, us, signature FROM alerts", "alerts"))
def snk1(spark, sf):
    path = table_dir(spark)
    sinks.write_table(V.alerts(spark, sf).select("row_id", "us", "signature"), path)
    return spark.read.parquet(path)


@query(
    "src5_window_csv_round_trip",
    V.check_sql("SELECT CAST(scenario AS VARCHAR) AS scenario, technique AS attack, start_us, end_us FROM windows", "windows"),
)
def src5(spark, sf):
    path = table_dir(spark)
    w = V.windows(spark, sf).select(
        F.col("scenario").cast("string").alias("scenario"), F.col("technique").alias("attack"),
        (F.col("start_us") / 1e6).cast("decimal(20,6)").alias("start"),
        (F.col("end_us") / 1e6).cast("decimal(20,6)").alias("end"),
    )
    sinks.write_table(w, path, "csv")
    return S.read_windows(spark, path)


@query(
    "src8_collection_csv_round_trip",
    V.check_sql(
        """SELECT (us // 1000000) * 1000000 AS us, rule_id, CAST(level AS DOUBLE) AS level, description, coalesce(path, '-') AS path
        FROM detailed""",
        "detailed",
    ),
)
def src8(spark, sf):
    path = table_dir(spark)
    d = V.detailed_alerts(spark, sf).select(
        F.col("alert_time").alias("timestamp"), "rule_id", "level", "description", "path"
    )
    sinks.write_table(d, path, "csv")
    return S.read_collection(spark, path).select(
        "us", "rule_id", "level", "description", F.coalesce("path", F.lit("-")).alias("path")
    )


@query(
    "snk2_split_sink",
    V.check_sql(
        "SELECT CASE WHEN k % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(sum(value), 2) AS total FROM alerts GROUP BY 1",
        "alerts",
    ),
)
def snk2(spark, sf):
    path = table_dir(spark)
    a = V.alerts(spark, sf).withColumns(
        {"y": F.col("auth_failure"), "split": F.when(F.col("k") % 5 == 0, "test").otherwise("train")}
    )
    sinks.write_split(a, path, ["level", "value", "k"])
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


_THRESHOLDS = """SELECT collection, count(*) AS n, round(max(value) FILTER (level = 3), 6) AS theta FROM alerts GROUP BY collection"""


def _threshold_rows(spark, sf):
    return V.alerts(spark, sf).groupBy("collection").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(F.when(F.col("level") == 3, F.col("value"))), 6).alias("theta")
    )


@query("src10_metric_artefact_scan", V.check_sql(_THRESHOLDS, "alerts"))
def src10(spark, sf):
    path = table_dir(spark)
    sinks.write_table(_threshold_rows(spark, sf), path, "csv")
    return S.read_metrics(spark, path, "collection string, n long, theta double")


@query("snk3_threshold_record", V.check_sql(_THRESHOLDS, "alerts"))
def snk3(spark, sf):
    path = table_dir(spark)
    sinks.write_thresholds(_threshold_rows(spark, sf), path)
    back = S.read_metrics(spark, path, "collection string, n long, theta double, written_at string", "json")
    return back.filter("written_at IS NOT NULL").drop("written_at")


# --- streams ---------------------------------------------------------------------------------


def _events_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    return spark.sql(V.base_sql(V.SPARK, "{src}"), src=raw)


def _drained(spark, stream, mode="append"):
    """Run a stream over everything there is, into a table, and read the table."""
    path = table_dir(spark)
    run = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", path + "_log")
        .trigger(availableNow=True).start(path)
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


#: Rows of a slice of the time range arrive together, some of them in a later slice.
_SLICES, _LATE, _SHIFT_US = 6, "8 days", 4 * 3_600_000_000
#: Rows of a file that alerts arrive in, and of all alerts of a group of agents that share state.
_FILE_ROWS, _GROUP_ROWS, _LEAST_GROUPS = 250_000, 10_000, 64


def _arriving(spark, sf, slices):
    """A folder that alerts arrive in, slice by slice and out of order, and a last row that moves the watermark on;
    and the number of files that hold a slice."""
    rows = V.alerts(spark, sf).select(
        F.col("scenario").cast("string").alias("agent"), "row_id", "us", F.col("level").cast("double").alias("level"),
        "rule_id", F.concat(F.lit("10.0.0."), "k").alias("srcip"), (F.col("auth_failure") > 0).alias("auth"),
        (F.col("kw_scan") > 0).alias("scan"), (F.col("kw_brute") > 0).alias("brute"),
    )
    rows = staged(rows)
    first, last, n = rows.agg(F.min("us"), F.max("us"), F.count(F.lit(1))).first()
    files = max(1, -(-n // (slices * _FILE_ROWS)))
    path = table_dir(spark)
    arrival = F.least(F.floor((F.col("us") + F.col("row_id") % 5 * _SHIFT_US - (first or 0)) / max(1, ((last or 0) - (first or 0)) // slices + 1)), F.lit(slices - 1))
    for i in range(slices):
        rows.filter(arrival == i).repartition(files).write.mode("append").parquet(path)
    end = spark.createDataFrame([("", None, (last or 0) + 400 * 86_400_000_000, 0.0, None, None, None, None, None)], rows.schema)
    end.coalesce(1).write.mode("append").parquet(path)
    return path, rows.schema, files


def _history_streamed(spark, sf, slices):
    """A micro-batch takes as many files as hold a slice, so there are as many as slices, whatever the input's size."""
    path, schema, files = _arriving(spark, sf, slices)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    with history_stream.rocksdb_state(spark):
        out = _drained(spark, history_stream.stream_history(stream, _LATE, groups=max(_LEAST_GROUPS, slices * files * _FILE_ROWS // _GROUP_ROWS)))
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in history_stream.FEATURES])


_STREAMED = V.check_sql(W._history_sql("scenario"), "alerts", numbered=W._NUMBERED.format("scenario"))


@query("str1_streaming_history", _STREAMED)
def str1(spark, sf):
    return _history_streamed(spark, sf, 1)


@query("str1_streaming_history_in_slices", _STREAMED)
def str1_slices(spark, sf):
    return _history_streamed(spark, sf, _SLICES)


@query(
    "str2_streaming_decision",
    V.check_sql(
        """SELECT row_id, CASE WHEN hit THEN 'forward' WHEN k / 100.0 >= 0.8 THEN 'suspicious' ELSE 'suppress' END AS decision,
        CASE WHEN hit THEN 'known_attack' WHEN k / 100.0 >= 0.8 THEN 'zero_day_candidate' ELSE 'benign' END AS category,
        CASE WHEN hit THEN 'l1' WHEN k / 100.0 >= 0.8 THEN 'l2' ELSE 'none' END AS layer
        FROM (SELECT *, value / 500 >= 0.1 AND NOT (rule_id IN ('31101', '31151', '5710', '5501') AND scenario % 4 = 0) AS hit FROM alerts)""",
        "alerts",
    ),
)
def str2(spark, sf):
    scored = _events_stream(spark, sf).withColumns(
        {
            "s1": F.col("value") / 500,
            "s2": F.col("k") / 100.0,
            "agent_criticality": F.when(F.col("scenario") % 4 == 0, 1.0).otherwise(3.0),
        }
    )
    decided = history_stream.stream_decisions(scored, 0.1, 0.8)
    return _drained(spark, decided.select("row_id", "decision", "category", "layer"))
