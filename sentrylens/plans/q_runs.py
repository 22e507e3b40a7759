"""Whole runs over files: read, features, labels, split, fit, threshold in one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.operators import features, models, splits
from sentrylens.operators.labels import label_asof
from sentrylens.plans import views as V
from sentrylens.plans.q_features import _read_files
from sentrylens.plans.registry import query
from sentrylens.session import staged
from sentrylens.sources import alerts as S

_FIT = models.Fit("chain", C.FEATURES, "temporal", trees=10, depth=3)


@query(
    "e1_training_run",
    V.check_sql(
        """SELECT 'chain' AS fit, count(*) AS n_test, CAST(sum(y) AS BIGINT) AS n_attack, count(*) - CAST(sum(y) AS BIGINT) AS n_benign, true AS beats_trivial
        FROM (SELECT y, row_number() OVER (ORDER BY us, row_id) AS r, count(*) OVER () AS n FROM l) WHERE r > CAST(floor(0.8 * n) AS BIGINT)""",
        "labelled",
        l="""SELECT a.row_id, a.us, CASE WHEN w.end_us IS NOT NULL AND a.us <= w.end_us THEN 1 ELSE 0 END AS y
        FROM (SELECT row_id, scenario, us // 1000000 * 1000000 AS us FROM alerts WHERE row_id % 50 NOT IN (7, 11)) a
        ASOF LEFT JOIN one_window w ON a.scenario = w.scenario AND a.us >= w.start_us""",
    ),
)
def e1(spark, sf):
    """Alert files to the F1-optimal threshold of boosted trees on the latest fifth."""
    flat = S.flatten(_read_files(spark, sf)).withColumns(
        {
            "scenario": F.col("agent_id").cast("long"), "us": F.unix_micros("ts"),
            "row_id": F.substring("location", 2, 20).cast("long"), "level": F.col("level").cast("int"),
        }
    )
    rows = features.features_v2(flat, ["scenario"], ["us", "row_id"], "us", keep=["row_id", "us", "scenario"])
    labelled = staged(label_asof(rows, V.windows(spark, sf), ["scenario"]))
    cut = splits.temporal_split(labelled, "us", "row_id")
    train, test = (cut.filter(F.col("split") == part) for part in ("train", "test"))
    fitted, fills = models.fit_many({"temporal": train}, [_FIT])
    best = models.best_f1(models.score_many({"temporal": test}, [_FIT], fitted, fills))
    n_attack, n_benign = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    share = n_attack / (n_attack + n_benign)
    return best.select(
        "fit", (n_attack + n_benign).alias("n_test"), n_attack.alias("n_attack"), n_benign.alias("n_benign"),
        (F.col("f1") >= 2 * share / (1 + share) - 1e-6).alias("beats_trivial"),
    )
