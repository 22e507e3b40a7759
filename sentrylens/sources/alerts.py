"""Readers of alerts, windows, markers, process events and small artefacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylens.functions import constants as C
from sentrylens.functions.timeparse import micros, parse_iso
from sentrylens.session import staged

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_WIN = _struct(
    system=_struct(systemTime=_S, message=_S, computer=_S, eventID=_S),
    eventdata=_struct(
        commandLine=_S, processGuid=_S, image=_S, parentImage=_S, targetUserName=_S, targetUser=_S
    ),
)
# list nodes that may also be scalars are read as text and lifted by ``text_list``
ALERT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", _S),
        T.StructField("@timestamp", _S),
        T.StructField(
            "rule",
            _struct(id=_S, level=_S, description=_S, groups=_S, mitre=_struct(tactic=_S, id=_S)),
        ),
        T.StructField("agent", _struct(id=_S, name=_S, ip=_S)),
        T.StructField(
            "data",
            _struct(
                srcip=_S, src_ip=_S, srcport=_S, srcuser=_S, dstuser=_S, command=_S, url=_S,
                http=_struct(url=_S, http_user_agent=_S), win=_WIN,
            ),
        ),
        T.StructField("syscheck", _struct(path=_S, event=_S, mtime_after=_S)),
        T.StructField("full_log", _S),
        T.StructField("location", _S),
    ]
)
ENVELOPE_SCHEMA = T.StructType(
    [*ALERT_SCHEMA.fields, T.StructField("score", _S), T.StructField("original_alert", ALERT_SCHEMA)]
)
ANOMALY_SCHEMA = _struct(
    AnalysisComponent=_struct(AnalysisComponentName=_S, TrainingMode=T.BooleanType()),
    LogData=_struct(
        DetectionTimestamp=T.ArrayType(_S), Timestamps=T.ArrayType(_S), RawLogData=T.ArrayType(_S),
        LogLinesCount=T.IntegerType(),
    ),
    AMiner=_struct(ID=_S),
)
WINDOW_SCHEMA = "scenario string, attack string, start double, end double"


def parse_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """SRC1: text rows to records; blank and malformed lines are dropped.

    Other columns of ``lines`` are kept. The validity test is separate from the typed
    parse, because a typed parse fills a broken line with nulls.
    """
    rest = [c for c in lines.columns if c != column]
    valid = lines.filter(F.try_parse_json(F.trim(column)).isNotNull() & F.trim(column).startswith("{"))
    return valid.select(*rest, F.from_json(column, schema).alias("_r")).select(*rest, "_r.*")


def read_alerts(spark: SparkSession, path: str, schema: T.StructType = ALERT_SCHEMA) -> DataFrame:
    """SRC1, SRC2: JSON-lines alerts with the file they come from."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    return parse_lines(text, schema)


def with_scenario(df: DataFrame, suffix: str, file_name: str = "file_name") -> DataFrame:
    """SRC2: scenario = file name without its suffix."""
    return df.withColumn("scenario", F.regexp_replace(file_name, f"{suffix.replace('.', '[.]')}$", ""))


def text_list(node: Column) -> Column:
    """A node read as text: a JSON list gives its items, a scalar one item, null none."""
    items = F.from_json(node, T.ArrayType(_S))
    return (
        F.when(node.isNull(), F.array().cast("array<string>"))
        .when(F.ltrim(node).startswith("["), items)
        .otherwise(F.array(node))
    )


def flatten(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """PRJ1: the nested alert as one flat row; missing nodes are null."""
    event = F.col("data.win.eventdata")
    return df.select(
        *keep,
        F.coalesce(parse_iso(F.col("timestamp")), parse_iso(F.col("`@timestamp`"))).alias("ts"),
        F.col("timestamp").alias("alert_time"),
        F.col("rule.id").alias("rule_id"),
        F.col("rule.level").alias("level"),
        F.col("rule.description").alias("description"),
        text_list(F.col("rule.groups")).alias("rule_groups"),
        text_list(F.col("rule.mitre.tactic")).alias("tactics"),
        F.array_join(text_list(F.col("rule.mitre.id")), ",").alias("mitre_ids"),
        F.col("agent.id").alias("agent_id"),
        F.col("agent.name").alias("agent_name"),
        F.col("data.srcip").alias("srcip"),
        F.col("data.srcuser").alias("srcuser"),
        F.coalesce("data.url", "data.http.url").alias("url"),
        F.coalesce(F.col("data.command"), event["commandLine"]).alias("command"),
        F.col("data.win.system.message").alias("message"),
        F.col("data.win.system.systemTime").alias("system_time"),
        event["processGuid"].alias("process_guid"),
        F.col("syscheck.path").alias("path"),
        F.col("syscheck.event").alias("fim_event"),
        F.col("syscheck.mtime_after").alias("mtime"),
        "full_log",
        "location",
    )


def unwrap(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """SRC3: take the alert out of its envelope, if it has one.

    Time is the envelope's, else the alert's; a missing or bad score is 0. Rows
    without any time are dropped.
    """
    own = F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in ALERT_SCHEMA.fields])
    inner = F.coalesce(F.col("original_alert"), own)
    out = df.select(
        *keep,
        F.coalesce(
            parse_iso(F.col("timestamp")),
            parse_iso(inner["timestamp"]),
            parse_iso(inner["@timestamp"]),
        ).alias("ts"),
        F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"),
        inner.alias("alert"),
    )
    return out.filter(F.col("ts").isNotNull())


def anomaly_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """SRC4: log-anomaly records; epoch from the first detection time, else the first log time."""
    def first(c: str) -> Column:
        return F.get(F.col(c), 0).try_cast("double")

    return df.select(
        *keep,
        F.coalesce(first("LogData.DetectionTimestamp"), first("LogData.Timestamps")).alias("epoch"),
        F.col("AnalysisComponent.AnalysisComponentName").alias("signature"),
        F.col("AnalysisComponent.TrainingMode").alias("training_mode"),
        F.col("LogData.RawLogData").alias("raw_log"),
        F.col("AMiner.ID").alias("source_id"),
    )


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: attack windows (scenario, attack, start, end in epoch seconds)."""
    w = spark.read.schema(WINDOW_SCHEMA).csv(path, header=True)
    return w.select(
        "scenario",
        "attack",
        F.round(F.col("start") * 1_000_000).cast("long").alias("start_us"),
        F.round(F.col("end") * 1_000_000).cast("long").alias("end_us"),
    )


def parse_markers(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC6: marker lines to (us, kind, rest, technique); other lines are dropped."""
    rest = [c for c in lines.columns if c != column]
    text = F.trim(column)
    part = [F.regexp_extract(text, C.MARKER_PATTERN, i) for i in (1, 2, 3)]
    return lines.filter(text.rlike(C.MARKER_PATTERN)).select(
        *rest,
        micros(parse_iso(part[0])).alias("us"),
        part[1].alias("kind"),
        part[2].alias("rest"),
        F.split(F.trim(part[2]), r"\s+")[0].alias("technique"),
    )


def read_markers(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """SRC6: marker log in UTF-8 or UTF-16; ``ord`` counts lines by file, then position.

    Plain "UTF-16" is read as little-endian, with or without a byte-order mark. Spark plans file
    splits by size, so the running id orders lines only within a split; the splits are
    ordered by file and offset.
    """
    if encoding.upper() == "UTF-8":
        lines = spark.read.text(path)
    else:
        charset = "UTF-16LE" if encoding.upper() == "UTF-16" else encoding
        options = {"encoding": charset, "lineSep": "\n", "sep": "\u0001", "quote": ""}
        lines = spark.read.options(**options).schema("value string").csv(path)
    clean = F.regexp_replace("value", "^\ufeff|\r$", "")
    split = ["file_path", "file_block_start"]
    numbered = staged(
        lines.select(
            clean.alias("value"), *[F.col(f"_metadata.{c}") for c in split], F.monotonically_increasing_id().alias("_id")
        )
    )
    sizes = numbered.groupBy(*split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*split)) - F.col("_n")
    starts = sizes.select(*split, "_first", before.alias("_before"))
    placed = numbered.join(starts, split).select("value", (F.col("_before") + F.col("_id") - F.col("_first")).alias("ord"))
    return parse_markers(placed)


def process_events(xml: DataFrame, column: str = "xml", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """SRC7: event XML text to the process table (id 1) and the artefact table (11, 13)."""

    def data(name: str) -> Column:
        return F.regexp_extract(column, f"<Data Name=['\\\"]{name}['\\\"]>([^<]*)</Data>", 1)

    events = xml.withColumn("eid", F.regexp_extract(column, C.EVENT_ID_PATTERN, 1))
    processes = events.filter("eid = '1'").select(
        *keep,
        data("ProcessGuid").alias("process_guid"),
        data("ParentProcessGuid").alias("parent_guid"),
        data("UtcTime").alias("utc_time"),
        data("ProcessId").alias("process_id"),
        data("Image").alias("image"),
        data("CommandLine").alias("command_line"),
        data("ParentImage").alias("parent_image"),
        data("User").alias("user"),
    )
    target = F.coalesce(F.nullif(data("TargetFilename"), F.lit("")), data("TargetObject"))
    artefacts = events.filter(F.col("eid").isin("11", "13")).select(
        *keep,
        "eid",
        data("ProcessGuid").alias("process_guid"),
        data("UtcTime").alias("utc_time"),
        data("Image").alias("image"),
        target.alias("target"),
    )
    return processes, artefacts


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: collection CSV (timestamp, rule, level, description, path)."""
    schema = "timestamp string, rule_id string, level double, description string, path string"
    c = spark.read.schema(schema).csv(path, header=True, escape='"')
    return c.withColumn("us", micros(parse_iso(F.col("timestamp"))))


def id_set(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC9: distinct trimmed non-empty ids."""
    return lines.select(F.trim(column).alias("id")).filter("id <> ''").distinct()


def read_idset(spark: SparkSession, path: str) -> DataFrame:
    return id_set(spark.read.text(path))


def read_metrics(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """SRC10: score or metric artefact in CSV or JSON."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.json(path)
