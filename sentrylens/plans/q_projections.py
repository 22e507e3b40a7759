"""Queries for the projections (PRJ) and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions import flags, timeparse, weblog
from sentrylens.plans import views as V
from sentrylens.plans.registry import query


def _sql_list(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def _sql_or(expr: str, items, op: str = "contains") -> str:
    return "(" + " OR ".join(f"{op}({expr}, '{i}')" for i in items) + ")"


_TEXT = (
    "lower(coalesce(description, '') || ' ' || coalesce(full_log, '') || ' ' || coalesce(command, '')"
    " || ' ' || '' || coalesce(list_aggregate(list_transform(list_filter(list_transform(tactics,"
    " lambda t: CASE lower(t) "
    + " ".join(f"WHEN '{t}' THEN '{w}'" for t, w in C.TACTIC_WORDS.items())
    + " END), lambda w: w IS NOT NULL), lambda w: ' ' || w), 'string_agg', ''), ''))"
)


@query(
    "prj1_null_tolerant_get",
    V.check_sql(
        """SELECT row_id, coalesce(srcuser, 'unknown') AS user_or_default,
        CAST(CASE WHEN srcuser IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_users,
        CAST(coalesce(len(tactics), 0) AS BIGINT) AS n_tactics FROM detailed""",
        "detailed",
    ),
)
def prj1(spark, sf):
    return V.detailed_alerts(spark, sf).select(
        "row_id",
        F.coalesce("srcuser", F.lit("unknown")).alias("user_or_default"),
        F.size(flags.as_list(F.col("srcuser"))).cast("long").alias("n_users"),
        F.size(flags.lowered(F.col("tactics"))).cast("long").alias("n_tactics"),
    )


@query(
    "prj2_timestamp_to_utc",
    V.check_sql("SELECT row_id, (us // 1000000) * 1000000 AS parsed_us FROM alerts", "alerts"),
)
def prj2(spark, sf):
    d = V.detailed_alerts(spark, sf)
    # the first field is missing or broken on part of the rows, so the second one counts
    first = F.when(F.col("row_id") % 5 == 0, F.lit("n/a")).when(
        F.col("row_id") % 5 != 1, F.col("alert_time")
    )
    return d.select(
        "row_id",
        timeparse.micros(timeparse.parse_first(first, F.col("alert_time"))).alias("parsed_us"),
    )


@query(
    "prj3_seven_format_parser",
    V.check_sql(
        """SELECT row_id, CASE WHEN row_id % 8 = 7 THEN -1
        ELSE CASE WHEN row_id % 8 IN (0, 4) THEN us - us % 1000 WHEN row_id % 8 = 3 THEN us
        ELSE us - us % 1000000 END END AS parsed_us FROM alerts""",
        "alerts",
    ),
)
def prj3(spark, sf):
    a = V.alerts(spark, sf)
    t = F.timestamp_micros("us")
    formats = [
        "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'", "yyyy-MM-dd'T'HH:mm:ss'+0000'", "yyyy-MM-dd'T'HH:mm:ss'Z'",
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss",
        "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy",
    ]
    text = F.coalesce(
        *[F.when(F.col("row_id") % 8 == i, F.date_format(t, f)) for i, f in enumerate(formats)]
    )
    return a.select(
        "row_id",
        F.coalesce(timeparse.micros(timeparse.parse_seven(text)), F.lit(-1)).alias("parsed_us"),
    )


@query(
    "prj4_os_event_time",
    V.check_sql(
        """SELECT row_id, CASE WHEN event_type = 'view' THEN (us - (k % 150) * 1000000) // 1000000
        ELSE us // 1000000 END AS event_s FROM alerts""",
        "alerts",
    ),
)
def prj4(spark, sf):
    t = timeparse.os_event_time(F.col("mtime"), F.col("alert_time"))
    return V.detailed_alerts(spark, sf).select("row_id", F.unix_seconds(t).alias("event_s"))


@query(
    "prj5_event_time_cascade",
    V.check_sql(
        """SELECT row_id,
          CASE time_source WHEN 'full_log_syslog' THEN us // 1000000 - 30
            WHEN 'full_log_clf' THEN us // 1000000 - 20 WHEN 'audit_epoch' THEN us // 1000000
            WHEN 'syscheck_mtime' THEN us // 1000000 - k % 150 ELSE us // 1000000 END AS event_s,
          time_source,
          CASE time_source WHEN 'alert_timestamp' THEN 80.0 WHEN 'full_log_clf' THEN 1.0
            WHEN 'syscheck_mtime' THEN 1.0 ELSE 0.0 END AS time_uncertainty_s
        FROM (SELECT *, CASE event_type WHEN 'error' THEN 'full_log_syslog'
            WHEN 'click' THEN 'full_log_clf' WHEN 'purchase' THEN 'audit_epoch'
            WHEN 'view' THEN CASE WHEN row_id % 3 < 2 AND k % 150 BETWEEN 15 AND 120
                THEN 'syscheck_mtime' ELSE 'alert_timestamp' END
            ELSE 'alert_timestamp' END AS time_source FROM alerts)""",
        "alerts",
    ),
)
def prj5(spark, sf):
    d = V.detailed_alerts(spark, sf)
    found = timeparse.event_time(
        F.col("full_log"), F.col("alert_time"), F.col("fim_event"), F.col("mtime")
    )
    return d.select("row_id", found.alias("t")).select(
        "row_id",
        F.floor(F.col("t.us") / 1_000_000).alias("event_s"),
        "t.time_source",
        "t.time_uncertainty_s",
    )


def _combined():
    return flags.combined_text(
        F.col("description"), F.col("full_log"), F.col("command"), F.lit(None).cast("string"),
        F.col("tactics"),
    )


@query(
    "prj6_combined_text",
    V.check_sql(f"SELECT row_id, {_TEXT} AS text FROM detailed", "detailed"),
)
def prj6(spark, sf):
    return V.detailed_alerts(spark, sf).select("row_id", _combined().alias("text"))


@query(
    "prj7_keyword_flags",
    V.check_sql(
        "SELECT row_id, "
        + ", ".join(f"CAST(contains(text, '{w}') AS DOUBLE) AS kw_{w}" for w in C.KEYWORDS)
        + f" FROM (SELECT row_id, {_TEXT} AS text FROM detailed)",
        "detailed",
    ),
)
def prj7(spark, sf):
    d = V.detailed_alerts(spark, sf).select("row_id", _combined().alias("text"))
    return d.select("row_id", *[c.alias(n) for n, c in flags.keyword_flags(F.col("text")).items()])


@query(
    "prj7_keyword_flags_documents",
    "SELECT doc_id, "
    + ", ".join(f"CAST(contains(lower(text), '{w}') AS DOUBLE) AS kw_{w}" for w in C.KEYWORDS)
    + " FROM documents",
)
def prj7_documents(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return d.select("doc_id", *[c.alias(n) for n, c in flags.keyword_flags(F.col("text")).items()])


@query(
    "prj8_length_level_rule_code",
    V.check_sql(
        """SELECT row_id, CAST(length(description) AS DOUBLE) AS desc_len,
        coalesce(TRY_CAST(CASE WHEN row_id % 9 = 0 THEN 'high' ELSE CAST(level AS VARCHAR) END AS DOUBLE), 0.0)
          AS rule_level,
        CASE WHEN row_id % 7 = 0 THEN 0.0 ELSE CAST(rule_id AS DOUBLE) END AS rule_id_encoded
        FROM detailed""",
        "detailed",
    ),
)
def prj8(spark, sf):
    return V.detailed_alerts(spark, sf).select(
        "row_id",
        F.length("description").cast("double").alias("desc_len"),
        flags.number_or_zero(
            F.when(F.col("row_id") % 9 == 0, "high").otherwise(F.col("level").cast("string"))
        ).alias("rule_level"),
        flags.rule_id_code(
            F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("r"), "rule_id")).otherwise(F.col("rule_id"))
        ).alias("rule_id_encoded"),
    )


_GROUPS_LOW = "list_transform(rule_groups, lambda g: lower(g))"
_AUTH = f"CAST(list_has_any({_GROUPS_LOW}, [{_sql_list(C.AUTH_FAILURE_GROUPS)}]) AS DOUBLE)"
_WEB = (
    f"CAST(list_has_any({_GROUPS_LOW}, [{_sql_list(C.WEB_ATTACK_GROUPS)}]) OR "
    f"{_sql_or('lower(description)', C.WEB_ATTACK_PHRASES)} AS DOUBLE)"
)
_TACTIC = (
    "CAST(coalesce(list_filter(list_transform(tactics, lambda t: CASE lower(t) "
    + " ".join(f"WHEN '{t}' THEN {i}" for t, i in C.TACTIC_IDS.items())
    + " END), lambda i: i IS NOT NULL)[1], -1) AS DOUBLE)"
)
_CRIT = (
    "CASE "
    + " ".join(
        f"WHEN contains(lower(agent_name), '{p}') THEN {float(w)}" for p, w in C.AGENT_CRITICALITY.items()
    )
    + " ELSE 0.0 END"
)
_STAGE = (
    "CASE WHEN {0} BETWEEN 0 AND 2 THEN 0.0 WHEN {0} = 3 THEN 1.0 WHEN {0} BETWEEN 4 AND 6 THEN 2.0 "
    "WHEN {0} = 7 THEN 3.0 WHEN {0} IN (8, 9) THEN 2.0 WHEN {0} BETWEEN 10 AND 12 THEN 4.0 ELSE 2.0 END"
)


@query("prj9_auth_failure_flag", V.check_sql(f"SELECT row_id, {_AUTH} AS is_auth_failure FROM detailed", "detailed"))
def prj9(spark, sf):
    return V.detailed_alerts(spark, sf).select(
        "row_id", flags.is_auth_failure(F.col("rule_groups")).alias("is_auth_failure")
    )


@query("prj10_web_attack_flag", V.check_sql(f"SELECT row_id, {_WEB} AS is_web_attack FROM detailed", "detailed"))
def prj10(spark, sf):
    return V.detailed_alerts(spark, sf).select(
        "row_id",
        flags.is_web_attack(F.col("rule_groups"), F.col("description")).alias("is_web_attack"),
    )


@query("prj11_tactic_id", V.check_sql(f"SELECT row_id, {_TACTIC} AS mitre_tactic_id FROM detailed", "detailed"))
def prj11(spark, sf):
    return V.detailed_alerts(spark, sf).select(
        "row_id", flags.tactic_id(F.col("tactics")).alias("mitre_tactic_id")
    )


@query(
    "prj12_agent_criticality",
    V.check_sql(f"SELECT row_id, CAST({_CRIT} AS DOUBLE) AS agent_criticality FROM detailed", "detailed"),
)
def prj12(spark, sf):
    return V.detailed_alerts(spark, sf).select(
        "row_id", flags.agent_criticality(F.col("agent_name")).alias("agent_criticality")
    )


@query(
    "prj13_kill_chain_stage",
    V.check_sql(
        f"SELECT row_id, CAST({_STAGE.format('t')} AS DOUBLE) AS kill_chain_stage FROM "
        f"(SELECT row_id, {_TACTIC} AS t FROM detailed)",
        "detailed",
    ),
)
def prj13(spark, sf):
    return V.detailed_alerts(spark, sf).select(
        "row_id", flags.kill_chain_stage(flags.tactic_id(F.col("tactics"))).alias("kill_chain_stage")
    )


_CLASS_NAMES = ("event_category", "event_type", "event_outcome", "actor_type")


def class_sql(i: int) -> str:
    rules = " ".join(f"WHEN rule_id = '{r}' THEN {float(v[i])}" for r, v in C.RULE_CLASSES.items())
    groups = " ".join(
        f"WHEN len(list_filter({_GROUPS_LOW}, lambda g: {_sql_or('g', trig)})) > 0 THEN {float(v[i])}"
        for trig, v in C.GROUP_CLASSES
    )
    return f"CAST(CASE {rules} {groups} ELSE {float(C.DEFAULT_CLASS[i])} END AS DOUBLE)"


@query(
    "prj15_semantic_class",
    V.check_sql(
        "SELECT row_id, "
        + ", ".join(f"{class_sql(i)} AS {n}" for i, n in enumerate(_CLASS_NAMES))
        + " FROM (SELECT * REPLACE (CASE WHEN row_id % 2 = 0 THEN 'x' ELSE rule_id END AS rule_id) FROM detailed)",
        "detailed",
    ),
)
def prj15(spark, sf):
    # half of the rows lose their rule number, so that both the rule table and the groups decide
    rule = F.when(F.col("row_id") % 2 == 0, "x").otherwise(F.col("rule_id"))
    return (
        V.detailed_alerts(spark, sf)
        .select("row_id", flags.classify_rule(rule, F.col("rule_groups")).alias("c"))
        .select("row_id", "c.*")
    )


_RULE_TEXT = "coalesce(description, '') || ' ' || coalesce(full_log, '') || ' ' || coalesce(command, '')"


def _text_features_sql(text: str) -> str:
    # RE2 knows ASCII word borders only: other letters are first replaced by a plain one
    text = f"regexp_replace({text}, '[^\\P{{L}}a-zA-Z]', 'z', 'g')"
    sensitive, suid, privilege = (
        p.replace("(?iU)", "(?i)")
        for p in (C.SENSITIVE_PATH_PATTERN, C.SUID_PATTERN, C.PRIVILEGE_PATTERN)
    )
    return (
        f"CAST(regexp_matches({text}, '{sensitive}') AS DOUBLE) AS touches_sensitive_path, "
        f"CAST(regexp_matches({text}, '{suid}') AS DOUBLE) AS is_suid_check, "
        f"CAST(least(len(regexp_extract_all({text}, '{privilege}')), 5) AS DOUBLE)"
        " AS cmdline_priv_tokens"
    )


@query(
    "prj16_text_features",
    V.check_sql(f"SELECT row_id, {_text_features_sql(_RULE_TEXT)} FROM detailed", "detailed"),
)
def prj16(spark, sf):
    d = V.detailed_alerts(spark, sf).select(
        "row_id",
        F.array_join(
            F.array(*[flags.text_or_empty(F.col(c)) for c in ("description", "full_log", "command")]), " "
        ).alias("text"),
    )
    return d.select("row_id", *[c.alias(n) for n, c in flags.text_features(F.col("text")).items()])


@query(
    "prj16_text_features_documents",
    f"SELECT doc_id, {_text_features_sql('text')} FROM documents",
)
def prj16_documents(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", *[c.alias(n) for n, c in flags.text_features(F.col("text")).items()])


_NAUTH = (
    f"CAST(list_has_any({_GROUPS_LOW}, [{_sql_list(C.NORM_AUTH_FAILURE_GROUPS)}]) OR (level >= 6 AND "
    f"list_has_any({_GROUPS_LOW}, ['sshd', 'pam'])) AS DOUBLE)"
)
_NWEB = f"CAST(list_has_any({_GROUPS_LOW}, ['web', 'web_scan']) AS DOUBLE)"
_NCRIT = (
    "CAST(coalesce(greatest("
    + ", ".join(
        f"CASE WHEN contains(lower(agent_name), '{p}') THEN {w} END" for p, w in C.AGENT_CRITICALITY.items()
    )
    + "), 1) AS DOUBLE)"
)


@query(
    "prj17_normalised_variants",
    V.check_sql(
        f"""SELECT row_id, {_NAUTH} AS is_auth_failure, {_NWEB} AS is_web_attack,
        {_NCRIT} AS agent_criticality, round(level / 15.0, 6) AS severity_norm FROM detailed""",
        "detailed",
    ),
)
def prj17(spark, sf):
    return V.detailed_alerts(spark, sf).select(
        "row_id",
        flags.norm_is_auth_failure(F.col("rule_groups"), F.col("level")).alias("is_auth_failure"),
        flags.norm_is_web_attack(F.col("rule_groups")).alias("is_web_attack"),
        flags.agent_criticality_max(F.col("agent_name")).alias("agent_criticality"),
        F.round(F.col("level") / 15.0, 6).alias("severity_norm"),
    )


@query(
    "prj20_artifact_technique",
    V.check_sql(
        """SELECT row_id, coalesce(CASE path WHEN '/etc/cron.d/col_cron' THEN 'T1053.003'
        WHEN '/etc/systemd/system/col_svc.service' THEN 'T1543.002'
        WHEN '/etc/profile.d/col_profile.sh' THEN 'T1546.004'
        WHEN '/root/.ssh/authorized_keys' THEN 'T1098.004'
        ELSE CASE WHEN regexp_matches(path, '^/etc/(passwd|shadow|group|gshadow|subuid|subgid)') THEN 'T1136.001'
             WHEN path LIKE '%col\\_%' ESCAPE '\\' OR path LIKE '%coluser%' THEN 'UNMAPPED_COL_ARTIFACT' END
        END, 'none') AS technique FROM detailed""",
        "detailed",
    ),
)
def prj20(spark, sf):
    return V.detailed_alerts(spark, sf).select(
        "row_id", F.coalesce(flags.artifact_technique(F.col("path")), F.lit("none")).alias("technique")
    )


@query(
    "prj21_names_artifact",
    V.check_sql(
        f"""SELECT row_id, CAST(coalesce({_sql_or("coalesce(path,'') || ' ' || coalesce(command,'') || ' ' || coalesce(full_log,'')", C.ARTIFACT_TOKENS)}
        OR regexp_matches(path, '^/etc/(passwd|shadow|group|gshadow|subuid|subgid)'), false) AS BIGINT) AS names_artifact
        FROM detailed""",
        "detailed",
    ),
)
def prj21(spark, sf):
    return V.detailed_alerts(spark, sf).select(
        "row_id",
        flags.names_artifact(F.col("path"), F.col("command"), F.col("full_log"))
        .cast("long")
        .alias("names_artifact"),
    )


@query(
    "prj22_artifact_bucket",
    V.check_sql(
        """SELECT row_id, CASE WHEN k % 8 IN (0, 3, 5, 6) THEN 'exact_match'
        WHEN k % 8 IN (1, 4) THEN 'directory_class_only' ELSE 'unrelated' END AS bucket
        FROM alerts WHERE event_type = 'view' UNION ALL
        SELECT row_id, 'unrelated' FROM alerts WHERE event_type <> 'view'""",
        "alerts",
    ),
)
def prj22(spark, sf):
    d = V.detailed_alerts(spark, sf)
    record = F.to_json(F.struct("rule_id", "description", "path", "command", "full_log"))
    return d.select("row_id", flags.artifact_bucket(F.col("path"), record).alias("bucket"))


@query(
    "prj23_http_log_parse",
    V.check_sql(
        """SELECT row_id, srcip AS ip, 'GET' AS method, url AS path, 'HTTP/1.1' AS proto,
        CASE WHEN k % 2 = 0 THEN '404' ELSE '200' END AS status, '153' AS size, '-' AS referrer,
        'agent/' || CAST(k % 4 AS VARCHAR) AS agent FROM detailed WHERE event_type = 'click'""",
        "detailed",
    ),
)
def prj23(spark, sf):
    d = V.detailed_alerts(spark, sf).withColumns(
        {
            "p": weblog.parse_access_line(F.col("full_log")),
            "v": weblog.parse_access_line(F.concat(F.lit("www:80 "), "full_log"), vhost=True),
        }
    )
    both = d.filter(F.col("p").isNotNull() & (F.col("p") == F.col("v")))
    return both.select("row_id", "p.*").drop("time")


@query(
    "prj24_url_features",
    """SELECT page_id,
      CASE WHEN trim(path, '/') = '' THEN 0 ELSE CAST(len(string_split(trim(path, '/'), '/')) AS BIGINT) END AS path_depth,
      CAST(length(path) AS BIGINT) AS path_length,
      CAST(ext_class <> 'none' AS BIGINT) AS has_extension, ext_class,
      CAST(starts_with(path, '/.') AS BIGINT) AS is_dotfile, CAST(contains(path, '?') AS BIGINT) AS has_query
    FROM (SELECT *, CASE WHEN NOT contains(base, '.') THEN 'none'
        WHEN ext = '' THEN 'none'
        WHEN ext IN ('php','cgi','asp','aspx','jsp','pl','py','sh') THEN 'script'
        WHEN ext IN ('conf','config','ini','xml','yml','yaml','env') THEN 'config'
        WHEN ext IN ('bak','old','swp','orig','save','tmp','1') THEN 'backup'
        WHEN ext = 'log' THEN 'log' ELSE 'other' END AS ext_class
      FROM (SELECT page_id, path, string_split(path, '/')[-1] AS base,
              lower(string_split(string_split(path, '/')[-1], '.')[-1]) AS ext
            FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages)))""",
)
def prj24(spark, sf):
    p = V.table(spark, sf, "pages").select(
        "page_id", F.regexp_replace("url", "^https?://[^/]*", "").alias("path")
    )
    f = weblog.url_features(F.col("path"), F.lit("200"), F.lit("GET"))
    keep = ("path_depth", "path_length", "has_extension", "ext_class", "is_dotfile", "has_query")
    return p.select("page_id", *[f[c].alias(c) for c in keep])


_CHAR_COUNTS = """SELECT {0} AS id, round(-sum(c * 1.0 / n * log2(c * 1.0 / n)) + 0.0, 6) + 0.0 AS entropy
    FROM (SELECT {0}, count(*) AS c, sum(count(*)) OVER (PARTITION BY {0}) AS n
          FROM (SELECT {0}, unnest(string_split({1}, '')) AS ch FROM {2}) GROUP BY {0}, ch)
    GROUP BY {0}"""


@query("prj25_char_entropy_urls", _CHAR_COUNTS.format("page_id", "url", "pages"))
def prj25(spark, sf):
    return V.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.round(weblog.char_entropy(F.col("url")), 6).alias("entropy")
    )


@query("prj25_char_entropy_documents", _CHAR_COUNTS.format("doc_id", "text", "documents"))
def prj25_documents(spark, sf):
    return V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.round(weblog.char_entropy(F.col("text")), 6).alias("entropy")
    )


@query(
    "prj26_identity_codes",
    V.check_sql(
        """SELECT a.row_id, CAST(coalesce(t.code, -1) AS BIGINT) AS code,
        CAST(contains(agent_name, 'lnx') AS BIGINT) AS is_constant_agent
        FROM detailed a LEFT JOIN (SELECT srcip, row_number() OVER (ORDER BY srcip) - 1 AS code FROM
        (SELECT DISTINCT srcip FROM detailed WHERE event_type = 'error' AND level = 12 AND srcip IS NOT NULL)) t
        ON a.srcip = t.srcip""",
        "detailed",
    ),
)
def prj26(spark, sf):
    d = V.detailed_alerts(spark, sf).select("row_id", "srcip", "agent_name", "event_type", "level")
    codes = weblog.fit_codes(d.filter("event_type = 'error' AND level = 12"), "srcip")
    return weblog.apply_codes(d, codes, "srcip").select(
        "row_id", "code", (F.col("agent_name") == "lnx-dmz-01").cast("long").alias("is_constant_agent")
    )


@query(
    "prj27_actor_key",
    V.check_sql(
        """SELECT coalesce(CASE WHEN k % 3 <> 0 THEN 'user' || CAST(scenario % 7 AS VARCHAR) END, '-') AS actor,
        count(*) AS n FROM alerts GROUP BY 1""",
        "alerts",
    ),
)
def prj27(spark, sf):
    d = V.detailed_alerts(spark, sf)
    return d.groupBy(F.coalesce("srcuser", F.lit("-")).alias("actor")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj28_fim_path_class",
    V.check_sql(
        """SELECT row_id, CASE k % 8 WHEN 0 THEN 'cron' WHEN 1 THEN 'cron' WHEN 2 THEN 'account_mgmt'
        WHEN 3 THEN 'ssh_key' WHEN 4 THEN 'systemd' WHEN 5 THEN 'shell_rc' WHEN 6 THEN 'shell_rc'
        ELSE 'other' END AS path_class FROM alerts WHERE event_type = 'view'""",
        "alerts",
    ),
)
def prj28(spark, sf):
    d = V.detailed_alerts(spark, sf).select("row_id", flags.fim_path_class(F.col("path")).alias("path_class"))
    return d.filter(F.col("path_class").isNotNull())


_W = [[1.0, 0.5], [-0.25, 2.0], [0.125, 0.0]]


@query(
    "prj29_linear_alignment",
    V.check_sql(
        """SELECT row_id, round(level * 1.0 + k * -0.25 + value * 0.125, 6) AS aligned_0,
        round(level * 0.5 + k * 2.0 + value * 0.0, 6) AS aligned_1 FROM alerts""",
        "alerts",
    ),
)
def prj29(spark, sf):
    cols = flags.align(("level", "k", "value"), _W)
    return V.alerts(spark, sf).select("row_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query(
    "prj30_event_flags",
    V.check_sql(
        """SELECT row_id, CAST(rule_id IN ('31101', '31151', '31104', '31516') AS BIGINT) AS is_web_scan,
        CAST(rule_id IN ('5710', '5712', '5503', '60122', '60204') AS BIGINT) AS is_auth_fail,
        CAST(rule_id IN ('5501', '60106') AS BIGINT) AS is_auth_success,
        CAST(rule_id IN ('5901', '5902', '5903') AS BIGINT) AS is_account_mgmt FROM alerts""",
        "alerts",
    ),
)
def prj30(spark, sf):
    f = flags.event_flags(F.col("rule_id"))
    return V.alerts(spark, sf).select("row_id", *[c.cast("long").alias(n) for n, c in f.items()])
