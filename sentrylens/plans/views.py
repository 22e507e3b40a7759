"""Alert-shaped views over the given tables, for Spark and for the SQL check.

The adapter is one SQL text with a few dialect words, so both engines see the same
alerts; everything computed on top of it is written independently on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylens.operators.labels import label_asof
from sentrylens.session import staged

HOUR_US = 3_600_000_000
WINDOW_US = 6 * HOUR_US

SPARK = {
    "us": "unix_micros(CAST(ts AS TIMESTAMP))",
    "arr": "array",
    "none": "CAST(array() AS array<string>)",
    "iso": "date_format(timestamp_micros({0}), \"yyyy-MM-dd'T'HH:mm:ss\")",
    "clf": "date_format(timestamp_micros({0}), 'dd/MMM/yyyy:HH:mm:ss')",
    "second": "CAST(floor({0} / 1000000.0D) AS BIGINT)",
}
DUCK = {
    "us": "epoch_us(ts)",
    "arr": "list_value",
    "none": "CAST([] AS VARCHAR[])",
    "iso": "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S')",
    "clf": "strftime(make_timestamp({0}), '%d/%b/%Y:%H:%M:%S')",
    "second": "({0} // 1000000)",
}

RULES = {
    "error": ("5712", "5710", "5503", "5501"),
    "click": ("31151", "31104", "31101", "31108"),
    "view": ("554", "550", "553", "2832"),
    "purchase": ("5902", "5901", "5402", "5403"),
    "signup": ("60122", "60106", "19007", "1002"),
}
DESCRIPTIONS = {
    "error": "sshd: brute force attempt, access denied",
    "click": "Web server scan: XSS probe",
    "view": "File changed below root directory",
    "purchase": "User added with privilege",
    "signup": "Windows shell logon",
}


def _rule_case() -> str:
    cases = []
    for kind, (r12, r8, r5, r3) in RULES.items():
        cases.append(
            f"WHEN event_type = '{kind}' THEN CASE level WHEN 12 THEN '{r12}' WHEN 8 THEN '{r8}' "
            f"WHEN 5 THEN '{r5}' ELSE '{r3}' END"
        )
    return "CASE " + " ".join(cases) + " END"


def _description_case() -> str:
    return "CASE event_type " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in DESCRIPTIONS.items()
    ) + " END"


def base_sql(d: dict, source: str) -> str:
    """One row per event: keys, time, level, rule."""
    return f"""
    SELECT *, event_type || '_' || CAST(level AS STRING) AS signature, {_rule_case()} AS rule_id
    FROM (
      SELECT event_id AS row_id, {d['us']} AS us, user_id AS scenario, event_type AS collection,
             event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
             CAST(CASE WHEN value >= 100 THEN 12 WHEN value >= 60 THEN 8 WHEN value >= 30 THEN 5
                  ELSE 3 END AS BIGINT) AS level,
             CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS auth_failure,
             CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS BIGINT) AS kw_scan,
             CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS kw_brute
      FROM {source}
    ) AS raw"""


def detail_sql(d: dict, source: str) -> str:
    """The alert's text, list and time fields on top of ``base_sql``."""
    arr, none = d["arr"], d["none"]
    second = d["second"].format("us")
    return f"""
    SELECT *,
      '10.0.0.' || CAST(k AS STRING) AS srcip,
      CASE WHEN k % 3 = 0 THEN NULL ELSE 'user' || CAST(scenario % 7 AS STRING) END AS srcuser,
      CASE scenario % 4 WHEN 0 THEN 'lnx-dmz-01' WHEN 1 THEN 'WIN-DC-2' WHEN 2 THEN 'win_cli9'
           ELSE 'db-7' END AS agent_name,
      {_description_case()} AS description,
      CASE event_type
        WHEN 'error' THEN CASE WHEN level >= 8 THEN {arr}('syslog', 'SSHD', 'Authentication_Failed')
                               ELSE {arr}('syslog', 'sshd') END
        WHEN 'click' THEN CASE WHEN level = 12 THEN {arr}('web', 'accesslog', 'web_scan')
                               ELSE {arr}('accesslog') END
        WHEN 'view' THEN {arr}('ossec', 'syscheck')
        WHEN 'purchase' THEN CASE WHEN level >= 8 THEN {arr}('syslog', 'adduser')
                                  ELSE {arr}('syslog', 'misc') END
        ELSE CASE level WHEN 5 THEN {arr}('portscan') WHEN 3 THEN {none}
                        ELSE {arr}('windows', 'authentication_success') END
      END AS rule_groups,
      CASE event_type
        WHEN 'error' THEN {arr}('Credential Access')
        WHEN 'click' THEN {arr}('Unmapped', 'Discovery')
        WHEN 'view' THEN CASE WHEN level >= 8 THEN {arr}('Persistence', 'Defense Evasion') ELSE {none} END
        WHEN 'purchase' THEN {arr}('Privilege Escalation')
        ELSE CASE WHEN level = 12 THEN {arr}('Impact') WHEN level = 5 THEN {arr}('Collection')
             ELSE NULL END
      END AS tactics,
      CASE WHEN event_type = 'click' THEN '/p' || CAST(k AS STRING) || CASE k % 6 WHEN 0 THEN '.php'
           WHEN 1 THEN '/.env' WHEN 2 THEN '/a/b.bak?x=1' WHEN 3 THEN '' WHEN 4 THEN '/x.LOG'
           ELSE '/adm/index.html' END END AS url,
      CASE WHEN event_type = 'view' THEN CASE k % 8 WHEN 0 THEN '/etc/cron.d/col_cron'
           WHEN 1 THEN '/etc/cron.d/other' WHEN 2 THEN '/etc/passwd-'
           WHEN 3 THEN '/root/.ssh/authorized_keys' WHEN 4 THEN '/etc/systemd/system/x.service'
           WHEN 5 THEN '/etc/profile.d/col_profile.sh' WHEN 6 THEN '/home/coluser/.bashrc'
           ELSE '/var/tmp/f' || CAST(k AS STRING) END END AS path,
      CASE WHEN event_type = 'view' THEN CASE row_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified'
           ELSE 'deleted' END END AS fim_event,
      CASE WHEN event_type = 'purchase' THEN 'sudo su - ; chmod u+s /bin/x' || CAST(k AS STRING)
           END AS command,
      CASE WHEN event_type = 'view' THEN {d['iso'].format('(us - (k % 150) * 1000000)')} END AS mtime,
      {d['iso'].format('us')} || CASE row_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+0000' ELSE '' END
        AS alert_time,
      CASE
        WHEN event_type = 'error' THEN {d['iso'].format('(us - 30000000 + 10800000000)')}
             || '+03:00 host sshd[7]: Failed password for root'
        WHEN event_type = 'click' THEN '10.0.0.' || CAST(k AS STRING) || ' - - ['
             || {d['clf'].format('(us - 20000000)')} || ' +0000] "GET /p' || CAST(k AS STRING)
             || CASE k % 6 WHEN 0 THEN '.php' WHEN 1 THEN '/.env' WHEN 2 THEN '/a/b.bak?x=1'
                WHEN 3 THEN '' WHEN 4 THEN '/x.LOG' ELSE '/adm/index.html' END
             || ' HTTP/1.1" ' || CASE WHEN k % 2 = 0 THEN '404' ELSE '200' END || ' 153 "-" "agent/'
             || CAST(k % 4 AS STRING) || '"'
        WHEN event_type = 'purchase' THEN 'type=EXECVE msg=audit(' || CAST({second} AS STRING)
             || '.250:77): sudo COMMAND=/usr/bin/find -perm -4000 /etc/shadow'
        WHEN event_type = 'view' THEN 'file ' || CAST(k AS STRING) || ' changed'
        ELSE NULL
      END AS full_log
    FROM {source}"""


def windows_sql(source: str) -> str:
    """Attack windows: strong errors open a six-hour window of their scenario."""
    return f"""
    SELECT row_id AS window_no, scenario, us AS start_us, us + {WINDOW_US} AS end_us,
           CASE k % 5 WHEN 0 THEN 'T1595.003' WHEN 1 THEN 'T1110.001' WHEN 2 THEN 'T1136.001'
                WHEN 3 THEN 'T1053.003' ELSE 'T1098.004' END AS technique
    FROM {source} WHERE event_type = 'error' AND value >= 60"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(base_sql(SPARK, "{src}"), src=table(spark, sf_dir, "events"))


def detailed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(detail_sql(SPARK, "{src}"), src=alerts(spark, sf_dir))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(windows_sql("{src}"), src=alerts(spark, sf_dir))


def labelled(
    spark: SparkSession, sf_dir: str, detail: bool = False, carry=(), stage: bool = False
) -> DataFrame:
    """Alerts with their label; ``stage`` writes them once for jobs that read them often."""
    rows = (detailed_alerts if detail else alerts)(spark, sf_dir)
    out = label_asof(rows, windows(spark, sf_dir), ["scenario"], carry=carry)
    return staged(out) if stage else out


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature = flag and ship month, label = line status; the wide-volume view."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM")).alias("signature"),
        (F.col("l_linestatus") == "F").cast("int").alias("y"),
        "l_quantity",
        "l_extendedprice",
    )


# --- the same views for the SQL check -----------------------------------------------

_CTE = {
    "alerts": base_sql(DUCK, "events"),
    "detailed": detail_sql(DUCK, "alerts"),
    "windows": windows_sql("alerts"),
    "one_window": """
    SELECT * FROM windows
    QUALIFY row_number() OVER (PARTITION BY scenario, start_us ORDER BY end_us DESC, technique DESC) = 1""",
    "labelled": """
    SELECT a.*, CAST(CASE WHEN w.end_us IS NOT NULL AND a.us <= w.end_us THEN 1 ELSE 0 END AS INT) AS y,
           CASE WHEN a.us <= w.end_us THEN w.technique END AS technique
    FROM alerts a ASOF LEFT JOIN one_window w ON a.scenario = w.scenario AND a.us >= w.start_us""",
    "labelled_detailed": """
    SELECT a.*, CAST(CASE WHEN w.end_us IS NOT NULL AND a.us <= w.end_us THEN 1 ELSE 0 END AS INT) AS y,
           CASE WHEN a.us <= w.end_us THEN w.technique END AS technique
    FROM detailed a ASOF LEFT JOIN one_window w ON a.scenario = w.scenario AND a.us >= w.start_us""",
    "lines": """
    SELECT l_returnflag || '_' || strftime(l_shipdate, '%Y-%m') AS signature,
           CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS INT) AS y,
           l_quantity, l_extendedprice
    FROM lineitem""",
}
_NEEDS = {
    "alerts": (),
    "detailed": ("alerts",),
    "windows": ("alerts",),
    "one_window": ("alerts", "windows"),
    "labelled": ("alerts", "windows", "one_window"),
    "labelled_detailed": ("alerts", "detailed", "windows", "one_window"),
    "lines": (),
}


def check_sql(body: str, *views: str, **extra: str) -> str:
    """Prefix ``body`` with the views it reads and with ``extra`` named subqueries."""
    names: list[str] = []
    for v in views:
        for n in (*_NEEDS[v], v):
            if n not in names:
                names.append(n)
    parts = [f"{n} AS MATERIALIZED ({_CTE[n]})" for n in names]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
