"""Queries for interval joins, marker pairing, tiers and trees (JN, WIN15-17) and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylens.functions import flags
from sentrylens.operators import labels, rounds
from sentrylens.plans import views as V
from sentrylens.plans.registry import query


@query(
    "jn1_label_asof",
    V.check_sql("SELECT row_id, CAST(y AS BIGINT) AS y, coalesce(technique, '') AS technique FROM labelled", "labelled"),
)
def jn1(spark, sf):
    return V.labelled(spark, sf, carry=["technique"]).select(
        "row_id", F.col("y").cast("long").alias("y"), F.coalesce("technique", F.lit("")).alias("technique")
    )


@query(
    "jn2_label_contains",
    V.check_sql(
        """SELECT a.row_id, CAST(count(w.window_no) > 0 AS BIGINT) AS y FROM alerts a LEFT JOIN windows w
        ON a.scenario = w.scenario AND a.us BETWEEN w.start_us AND w.end_us GROUP BY a.row_id""",
        "windows",
    ),
)
def jn2(spark, sf):
    y = labels.label_contains(V.alerts(spark, sf), V.windows(spark, sf), ["scenario"])
    return y.select("row_id", F.col("y").cast("long").alias("y"))


@query(
    "jn3_first_window_technique",
    V.check_sql(
        """SELECT a.row_id, coalesce(min_by(w.technique, -w.window_no), '') AS technique FROM alerts a
        LEFT JOIN windows w ON a.scenario = w.scenario AND a.us BETWEEN w.start_us AND w.end_us GROUP BY a.row_id""",
        "windows",
    ),
)
def jn3(spark, sf):
    # the list is searched from its newest window on
    w = V.windows(spark, sf).withColumn("position", -F.col("window_no"))
    found = labels.first_window(V.alerts(spark, sf), w, ["scenario"], "position", ["technique"])
    return found.select("row_id", F.coalesce("technique", F.lit("")).alias("technique"))


_BASELINES = "SELECT row_id, scenario, us AS start_us, us + 7200000000 AS end_us FROM alerts WHERE event_type = 'signup'"
_HITS = """SELECT a.*, count(w.window_no) AS n_hits, CASE WHEN count(w.window_no) = 1 THEN min(w.technique) END AS hit_technique,
    (SELECT count(*) FROM baselines b WHERE b.scenario = a.scenario AND a.us >= b.start_us AND a.us < b.end_us) > 0 AS in_baseline
    FROM detailed a LEFT JOIN windows w ON a.scenario = w.scenario AND a.us BETWEEN w.start_us AND w.end_us
    GROUP BY ALL"""


def _hits(spark, sf):
    d = V.detailed_alerts(spark, sf)
    artifact = flags.names_artifact(F.col("path"), F.col("command"), F.col("full_log"))
    # the texts are reduced to their flag before anything is shuffled
    narrow = d.select(
        "row_id", "us", "scenario", "event_type", "srcuser",
        F.coalesce(artifact, F.lit(False)).alias("is_artifact"),
    )
    base = d.filter("event_type = 'signup'").select(
        "scenario", F.col("us").alias("start_us"), (F.col("us") + 7_200_000_000).alias("end_us")
    )
    return labels.classify_hits(narrow, V.windows(spark, sf), base, ["scenario"])


@query(
    "jn4_window_hit_classification",
    V.check_sql(
        "SELECT row_id, n_hits, coalesce(hit_technique, '') AS hit_technique, in_baseline FROM hits",
        "detailed", "windows", baselines=_BASELINES, hits=_HITS,
    ),
)
def jn4(spark, sf):
    return _hits(spark, sf).select(
        "row_id", "n_hits", F.coalesce("hit_technique", F.lit("")).alias("hit_technique"), "in_baseline"
    )


_TIERED_LINUX = """SELECT *, CASE WHEN n_hits = 1 THEN CASE WHEN exact THEN 'LOW-time' ELSE 'VLOW-time' END
    WHEN n_hits > 1 THEN 'UNCERTAIN-overlap' WHEN artifact THEN 'UNCERTAIN-artifact-teardown'
    WHEN in_baseline THEN CASE WHEN exact THEN 'BENIGN-baseline' ELSE 'BENIGN-baseline-weak' END
    WHEN in_session THEN 'UNCERTAIN-session-gap' ELSE 'UNCERTAIN-out-of-session' END AS label_confidence
    FROM (SELECT *, event_type <> 'signup' AS exact,
      event_type = 'view' AND k % 8 IN (0, 2, 3, 5, 6) AS artifact,
      us BETWEEN 1704153600000000 AND 1705968000000000 AS in_session FROM hits)"""
_SESSION = (1704153600000000, 1705968000000000)
_LABEL = """CASE WHEN label_confidence LIKE 'UNCERTAIN%' THEN 'uncertain' WHEN label_confidence LIKE 'BENIGN%'
    THEN 'benign' ELSE 'attack' END AS label,
    CASE WHEN n_hits = 1 THEN hit_technique WHEN n_hits > 1 THEN 'MULTI' ELSE '' END AS technique"""


def linux_tiers(spark, sf):
    return labels.tier_linux(
        _hits(spark, sf),
        F.col("is_artifact"),
        F.col("event_type") != "signup",
        F.col("us").between(*_SESSION),
    )


@query(
    "jn5_linux_label_tiers",
    V.check_sql(
        f"SELECT row_id, label_confidence, {_LABEL} FROM tiers",
        "detailed", "windows", baselines=_BASELINES, hits=_HITS, tiers=_TIERED_LINUX,
    ),
)
def jn5(spark, sf):
    return linux_tiers(spark, sf).select("row_id", "label_confidence", "label", "technique")


# Process forest: node n descends from n div 2; the tree of the root is every node that
# reaches it, and a back edge from the root to one of its descendants closes a cycle.
_EDGES = """SELECT CAST(floor(event_id / 2.0) AS BIGINT) AS parent, event_id AS child FROM {0} WHERE event_id > 0
    UNION ALL SELECT 22, 5 FROM {0} WHERE event_id = 1"""
_TREE = """SELECT event_id AS node FROM events WHERE event_id >= 5 AND (event_id >> CAST(floor(log2(event_id + 0.5)) - 2 AS INT)) = 5"""


def _tree(spark, sf):
    edges = spark.sql(_EDGES.format("{src}"), src=V.table(spark, sf, "events"))
    root = edges.filter("child = 5").select(F.col("child")).distinct()
    return labels.descendants(edges, root)


@query("jn8_transitive_closure", _TREE)
def jn8(spark, sf):
    return _tree(spark, sf)


@query(
    "jn7_descendant_membership",
    V.check_sql(
        "SELECT row_id, row_id IN (SELECT node FROM tree) AS in_tree FROM alerts", "alerts", tree=_TREE
    ),
)
def jn7(spark, sf):
    a = V.alerts(spark, sf).select("row_id")
    return labels.in_tree(a, _tree(spark, sf), "row_id", "node")


@query(
    "jn6_windows_label_tiers",
    V.check_sql(
        f"SELECT row_id, label_confidence, {_LABEL} FROM tiers",
        "detailed", "windows", baselines=_BASELINES, hits=_HITS, tree=_TREE,
        tiers="""SELECT *, CASE WHEN in_tree THEN CASE n_hits WHEN 0 THEN 'HIGH-process-session' WHEN 1 THEN 'HIGH-process'
            ELSE 'HIGH-process-overlap' END
          WHEN n_hits = 1 THEN 'LOW-time' WHEN n_hits > 1 THEN 'UNCERTAIN-overlap'
          WHEN us < 1704153600000000 THEN 'UNCERTAIN-pre-collection'
          WHEN us > 1705968000000000 THEN 'UNCERTAIN-post-marker'
          WHEN in_baseline THEN 'BENIGN-baseline' ELSE 'UNCERTAIN-session-gap' END AS label_confidence
          FROM (SELECT *, row_id IN (SELECT node FROM tree) AS in_tree FROM hits)""",
    ),
)
def jn6(spark, sf):
    h = labels.in_tree(_hits(spark, sf), _tree(spark, sf), "row_id", "node")
    t = labels.tier_windows(h, F.col("in_tree"), F.col("us") < _SESSION[0], F.col("us") > _SESSION[1])
    return t.select("row_id", "label_confidence", "label", "technique")


# Marker log derived from the events: one log per site, kind and text from the event.
_MARKERS = """SELECT row_id, us, scenario % 10 AS log, kind,
    CASE kind WHEN 'PHASE' THEN CASE WHEN k % 2 = 0 THEN 'KNOWN attacks' ELSE 'NOVEL attacks' END
      ELSE 'T' || CAST(k % 3 AS STRING) || ' step' END AS rest, 'T' || CAST(k % 3 AS STRING) AS technique
    FROM (SELECT *, CASE event_type WHEN 'error' THEN 'START' WHEN 'signup' THEN 'END' WHEN 'view' THEN 'PHASE'
      WHEN 'click' THEN 'BASELINE' ELSE 'EXPORT_TO' END AS kind FROM {0})"""


def _markers(spark, sf):
    return spark.sql(_MARKERS.format("{src}"), src=V.alerts(spark, sf))


@query(
    "jn9_pair_markers_last",
    V.check_sql(
        """SELECT log, technique, before_us AS start_us, us AS end_us FROM (SELECT *,
          lag(kind) OVER w AS before, lag(us) OVER w AS before_us FROM markers WHERE kind IN ('START', 'END')
          WINDOW w AS (PARTITION BY log, technique ORDER BY us, row_id))
        WHERE kind = 'END' AND before = 'START'""",
        "alerts", markers=_MARKERS.format("alerts"),
    ),
)
def jn9_last(spark, sf):
    m = _markers(spark, sf)
    return rounds.pair_markers_last(m, ["log", "technique"], ["us", "row_id"])


@query(
    "jn9_pair_markers_fifo",
    V.check_sql(
        """SELECT s.log, s.technique, s.us AS start_us, e.us AS end_us FROM lows s JOIN lows e
          ON s.kind = 'START' AND e.kind = 'END' AND e.bal >= e.low_before AND s.log = e.log
          AND s.technique = e.technique AND s.s = e.e + e.low WHERE e.us > s.us""",
        "alerts",
        markers=_MARKERS.format("alerts"),
        ranked="""SELECT *, sum(CASE WHEN kind = 'START' THEN 1 ELSE 0 END) OVER w AS s,
            sum(CASE WHEN kind = 'END' THEN 1 ELSE 0 END) OVER w AS e FROM markers WHERE kind IN ('START', 'END')
            WINDOW w AS (PARTITION BY log, technique ORDER BY us, row_id)""",
        lows="""SELECT *, least(0, min(s - e) OVER w) AS low, s - e AS bal,
            least(0, coalesce(min(s - e) OVER (PARTITION BY log, technique ORDER BY us, row_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low_before FROM ranked
            WINDOW w AS (PARTITION BY log, technique ORDER BY us, row_id)""",
    ),
)
def jn9_fifo(spark, sf):
    return rounds.pair_markers_fifo(_markers(spark, sf), ["log", "technique"], ["us", "row_id"])


@query(
    "win15_round_number",
    V.check_sql(
        """SELECT row_id, CAST(sum(CASE WHEN kind = 'PHASE' AND rest LIKE 'KNOWN%' THEN 1 ELSE 0 END) OVER
          (PARTITION BY log ORDER BY us, row_id) AS BIGINT) AS round FROM markers""",
        "alerts", markers=_MARKERS.format("alerts"),
    ),
)
def win15(spark, sf):
    return rounds.round_numbers(_markers(spark, sf), ["log"], ["us", "row_id"]).select("row_id", "round")


@query(
    "win16_baseline_windows",
    V.check_sql(
        "SELECT row_id, log, us AS start_us, us + 90000000 AS end_us FROM markers WHERE kind = 'BASELINE'",
        "alerts", markers=_MARKERS.format("alerts"),
    ),
)
def win16(spark, sf):
    return rounds.baseline_windows(_markers(spark, sf)).select("row_id", "log", "start_us", "end_us")


@query(
    "win17_buffered_windows",
    V.check_sql(
        "SELECT window_no, start_us - 60000000 AS start_us, end_us + 60000000 AS end_us FROM windows", "windows"
    ),
)
def win17(spark, sf):
    return rounds.buffer_windows(V.windows(spark, sf)).select("window_no", "start_us", "end_us")


@query(
    "jn10_nearest_window_offset",
    V.check_sql(
        """SELECT row_id, round(d / 1000000.0, 6) AS offset_s FROM (SELECT a.row_id,
          CASE WHEN a.us BETWEEN w.start_us AND w.end_us THEN 0 WHEN a.us > w.end_us THEN a.us - w.end_us
          ELSE a.us - w.start_us END AS d FROM alerts a JOIN windows w ON a.scenario = w.scenario)
        QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY abs(d), d DESC) = 1""",
        "windows",
    ),
)
def jn10(spark, sf):
    n = labels.nearest_window_offset(V.alerts(spark, sf), V.windows(spark, sf), ["scenario"])
    return n.filter("offset_s IS NOT NULL").select("row_id", F.round("offset_s", 6).alias("offset_s"))
