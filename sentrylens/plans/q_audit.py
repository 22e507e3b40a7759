"""Queries for the audit tables (AGG) and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions import flags
from sentrylens.functions.stats import wilson
from sentrylens.operators import audit, labels, trailing
from sentrylens.plans import views as V
from sentrylens.plans.q_labels import _BASELINES, _HITS, _LABEL, _TIERED_LINUX, linux_tiers
from sentrylens.plans.registry import query
from sentrylens.session import staged

_MAJ = """SELECT signature, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_attack,
    CASE WHEN 2 * sum(y) >= count(*) THEN 1 ELSE 0 END AS majority FROM labelled GROUP BY signature"""
_RATES = """round(tp * 1.0 / nullif(tp + fp, 0), 6) AS precision, round(tp * 1.0 / nullif(tp + fn, 0), 6) AS recall,
    round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(fp * 1.0 / nullif(fp + tn, 0), 6) AS fpr,
    round(fn * 1.0 / nullif(tp + fn, 0), 6) AS fnr"""
_CELLS = """count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
    count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 1 AND pred = 0) AS fn"""


def rounded(df, digits: int = 6):
    """Round every double column, so that both engines show the same digits."""
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema]
    )


def _scored(spark, sf):
    l = V.labelled(spark, sf)
    return audit.apply_lookup(l, audit.fit_lookup(l, "signature"), "signature")


_SCORED = "SELECT l.*, m.majority AS pred FROM labelled l JOIN maj m USING (signature)"


@query(
    "agg1_majority_table",
    V.check_sql(
        "SELECT signature, n, n_attack, n - n_attack AS n_benign, CAST(majority AS BIGINT) AS majority FROM maj",
        "labelled", maj=_MAJ,
    ),
)
def agg1(spark, sf):
    t = audit.fit_lookup(V.labelled(spark, sf), "signature")
    return t.withColumn("majority", F.col("majority").cast("long"))


@query(
    "jn11_lookup_apply",
    V.check_sql(
        """SELECT l.row_id, CAST(coalesce(m.majority, 0) AS BIGINT) AS pred FROM labelled l
        LEFT JOIN (SELECT signature, CASE WHEN 2 * sum(y) >= count(*) THEN 1 ELSE 0 END AS majority FROM labelled
          WHERE level <> 12 GROUP BY 1) m USING (signature)""",
        "labelled",
    ),
)
def jn11(spark, sf):
    # the strongest level is unseen in train
    l = V.labelled(spark, sf)
    p = audit.apply_lookup(l, audit.fit_lookup(l.filter("level <> 12"), "signature"), "signature")
    return p.select("row_id", F.col("pred").cast("long").alias("pred"))


@query(
    "agg2_confusion",
    V.check_sql(
        f"SELECT tp, fp, tn, fn, {_RATES} FROM (SELECT {_CELLS} FROM scored)", "labelled", maj=_MAJ, scored=_SCORED
    ),
)
def agg2(spark, sf):
    return rounded(audit.confusion(_scored(spark, sf)))


@query(
    "agg3_confusion_per_rule",
    V.check_sql(
        f"SELECT rule_id, tp, fp, tn, fn, {_RATES} FROM (SELECT rule_id, {_CELLS} FROM scored GROUP BY rule_id)",
        "labelled", maj=_MAJ, scored=_SCORED,
    ),
)
def agg3(spark, sf):
    return rounded(audit.confusion(_scored(spark, sf), by=["rule_id"]))


@query(
    "agg2_confusion_lines",
    V.check_sql(
        f"SELECT tp, fp, tn, fn, {_RATES} FROM (SELECT {_CELLS} FROM scored)",
        "lines",
        maj="SELECT signature, CASE WHEN 2 * sum(y) >= count(*) THEN 1 ELSE 0 END AS pred FROM lines GROUP BY 1",
        scored="SELECT * FROM lines JOIN maj USING (signature)",
    ),
)
def agg2_lines(spark, sf):
    l = V.lines(spark, sf)
    return rounded(audit.confusion(audit.apply_lookup(l, audit.fit_lookup(l, "signature"), "signature")))


_TRIVIAL = """round(p, 6) AS trivial_precision, CASE WHEN n_attack > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS trivial_recall,
    round(2 * p / (1 + p), 6) AS trivial_f1"""


@query(
    "agg4_trivial_baseline",
    V.check_sql(
        f"""SELECT collection, n, n_attack, {_TRIVIAL} FROM (SELECT collection, count(*) AS n,
        CAST(sum(y) AS BIGINT) AS n_attack, avg(y) AS p FROM labelled GROUP BY collection)""",
        "labelled",
    ),
)
def agg4(spark, sf):
    return rounded(audit.trivial_baseline(V.labelled(spark, sf), by=["collection"]))


_FLAGSHIP_BY = "collection"


def flagship(spark, sf):
    """Per collection: does a per-signature lookup beat the always-attack detector?"""
    l = V.labelled(spark, sf)
    return rounded(audit.lookup_vs_trivial(l, l, "signature", by=[_FLAGSHIP_BY]))


query(
    "audit_lookup_vs_trivial",
    V.check_sql(
        f"""SELECT collection, tp, fp, tn, fn, {_RATES}, round(2 * p / (1 + p), 6) AS trivial_f1
        FROM (SELECT collection, {_CELLS}, avg(y) AS p FROM scored GROUP BY collection)""",
        "labelled", maj=_MAJ, scored=_SCORED,
    ),
)(flagship)


_PURITY = """SELECT signature, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_attack,
    greatest(avg(y), 1 - avg(y)) AS purity FROM {0} GROUP BY signature"""


@query(
    "agg5_purity",
    V.check_sql(
        """SELECT signature, n, n_attack, n - n_attack AS n_benign, round(purity, 6) AS purity,
        CASE WHEN 2 * n_attack >= n THEN 'attack-leaning' ELSE 'benign-leaning' END AS direction FROM pur""",
        "labelled", pur=_PURITY.format("labelled"),
    ),
)
def agg5(spark, sf):
    return rounded(audit.purity(V.labelled(spark, sf), "signature"))


@query(
    "agg5_purity_documents",
    """SELECT source, n, n_attack, n - n_attack AS n_benign, round(greatest(n_attack * 1.0 / n, 1 - n_attack * 1.0 / n), 6) AS purity,
    CASE WHEN 2 * n_attack >= n THEN 'attack-leaning' ELSE 'benign-leaning' END AS direction
    FROM (SELECT source, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS n_attack FROM documents JOIN labels USING (doc_id) GROUP BY source)""",
)
def agg5_documents(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "source").join(V.table(spark, sf, "labels"), "doc_id")
    return rounded(audit.purity(d, "source", "toxic"))


_FINE = "SELECT * REPLACE (signature || '_' || CAST(k AS VARCHAR) AS signature) FROM labelled"


def _fine(spark, sf):
    """Finer signatures, so that every purity band is populated."""
    return V.labelled(spark, sf).withColumn("signature", F.concat_ws("_", "signature", "k"))


@query(
    "agg6_purity_bands",
    V.check_sql(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS band, count(*) FILTER (purity >= {lo!r} AND purity < {hi!r}) AS n_sig,
            CAST(coalesce(sum(n) FILTER (purity >= {lo!r} AND purity < {hi!r}), 0) AS BIGINT) AS volume,
            round(100.0 * coalesce(sum(n) FILTER (purity >= {lo!r} AND purity < {hi!r}), 0) / sum(n), 6) AS pct FROM pur"""
            for name, lo, hi in C.PURITY_BANDS
        ),
        "labelled", fine=_FINE, pur=_PURITY.format("fine"),
    ),
)
def agg6(spark, sf):
    return rounded(audit.purity_bands(audit.purity(_fine(spark, sf), "signature")))


@query(
    "agg7_label_proxy_exposure",
    V.check_sql(
        """SELECT CAST(sum(n) AS BIGINT) AS n_total, CAST(coalesce(sum(n) FILTER (purity >= 0.99), 0) AS BIGINT) AS n_exposed,
        round(100.0 * coalesce(sum(n) FILTER (purity >= 0.99), 0) / sum(n), 6) AS exposure_pct FROM pur""",
        "labelled", fine=_FINE, pur=_PURITY.format("fine"),
    ),
)
def agg7(spark, sf):
    return rounded(audit.exposure(audit.purity(_fine(spark, sf), "signature")))


@query(
    "srt2_top5_by_volume",
    V.check_sql(
        "SELECT signature, n, n_attack, round(purity, 6) AS purity FROM pur ORDER BY n DESC, signature LIMIT 5",
        "lines", pur=_PURITY.format("lines"),
    ),
)
def srt2(spark, sf):
    t = audit.top_by_volume(audit.purity(V.lines(spark, sf), "signature"), "signature")
    return rounded(t.select("signature", "n", "n_attack", "purity"))


@query(
    "agg8_exclusivity",
    V.check_sql(
        """SELECT CASE WHEN n_attack = n THEN 'attack_only' WHEN n_attack = 0 THEN 'benign_only' ELSE 'mixed' END AS side,
        count(*) AS n_sig, CAST(sum(n) AS BIGINT) AS volume, CAST(sum(n_attack) AS BIGINT) AS n_attack FROM pur GROUP BY 1""",
        "labelled", fine=_FINE, pur=_PURITY.format("fine"),
    ),
)
def agg8(spark, sf):
    return audit.exclusivity(_fine(spark, sf), "signature")


_RATIO = """SELECT *, n - n_attack AS n_benign, CASE WHEN n = n_attack THEN 1e300 ELSE n_attack * 1.0 / (n - n_attack) END AS ratio FROM pur"""


@query(
    "agg9_ratio_bands",
    V.check_sql(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS band, count(*) FILTER ({cond}) AS n_sig,
            CAST(coalesce(sum(n) FILTER ({cond}), 0) AS BIGINT) AS volume,
            round(100.0 * coalesce(sum(n) FILTER ({cond}), 0) / sum(n), 6) AS pct FROM ratios"""
            for name, cond in [(f">={t}", f"ratio >= {t}") for t in C.RATIO_BANDS] + [("exclusive", "n_benign = 0")]
        ),
        "labelled", fine=_FINE, pur=_PURITY.format("fine"), ratios=_RATIO,
    ),
)
def agg9(spark, sf):
    return rounded(audit.ratio_bands(audit.ratio_table(_fine(spark, sf), "signature")))


_NMI = """SELECT n, round(ha + hb - hj, 6) AS mi, round((ha + hb - hj) / ((ha + hb) / 2), 6) AS nmi FROM
    (SELECT sum(c) AS n, -sum(c / n * ln(c / n)) AS hj FROM (SELECT count(*) * 1.0 AS c, sum(count(*)) OVER () AS n FROM {0} GROUP BY {1}, {2})) j,
    (SELECT -sum(c / n * ln(c / n)) AS ha FROM (SELECT count(*) * 1.0 AS c, sum(count(*)) OVER () AS n FROM {0} GROUP BY {1})) a,
    (SELECT -sum(c / n * ln(c / n)) AS hb FROM (SELECT count(*) * 1.0 AS c, sum(count(*)) OVER () AS n FROM {0} GROUP BY {2})) b"""


@query(
    "agg10_nmi",
    V.check_sql(_NMI.format("labelled", "signature", "y").replace("SELECT n,", "SELECT CAST(n AS BIGINT) AS n,", 1), "labelled"),
)
def agg10(spark, sf):
    return rounded(audit.nmi(V.labelled(spark, sf), "signature", "y"))


@query(
    "agg10_nmi_lines",
    V.check_sql(_NMI.format("lines", "signature", "y").replace("SELECT n,", "SELECT CAST(n AS BIGINT) AS n,", 1), "lines"),
)
def agg10_lines(spark, sf):
    return rounded(audit.nmi(V.lines(spark, sf), "signature", "y"))


_MI_COLS = ("level", "value", "k", "kw_scan", "kw_brute", "auth_failure")
_LONG = " UNION ALL ".join(f"SELECT y, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM labelled" for c in _MI_COLS)
_MI = """SELECT feature, CAST(sum(c) AS BIGINT) AS n, greatest(sum(c / n * ln(c * n / (nx * ny))), 0.0) AS mi FROM
    (SELECT feature, bin, y, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS nx,
       sum(c) OVER (PARTITION BY feature, y) AS ny
     FROM (SELECT feature, (first_rank - 1) * 16 // total AS bin, y, count(*) * 1.0 AS c FROM
       (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) AS first_rank, count(*) OVER (PARTITION BY feature) AS total FROM long)
       GROUP BY ALL)) GROUP BY feature"""


@query(
    "agg11_mutual_information_rank",
    V.check_sql(
        "SELECT feature, n, round(mi, 6) + 0.0 AS mi, mi >= 0.8 * max(mi) OVER () AND max(mi) OVER () > 0 AS flagged FROM mi",
        "labelled", long=_LONG, mi=_MI,
    ),
)
def agg11(spark, sf):
    return rounded(audit.mi_rank(V.labelled(spark, sf), _MI_COLS))


@query(
    "srt3_ranked_features",
    V.check_sql(
        "SELECT feature, round(mi, 6) + 0.0 AS mi, row_number() OVER (ORDER BY mi DESC, feature) AS place FROM mi",
        "labelled", long=_LONG, mi=_MI,
    ),
)
def srt3(spark, sf):
    ranked = audit.ranked_features(audit.mi_rank(V.labelled(spark, sf), _MI_COLS), "mi")
    return rounded(ranked.select("feature", "mi", "place"))


@query(
    "agg12_normalised_entropy",
    V.check_sql(
        """SELECT CAST(y AS BIGINT) AS y, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_distinct,
        round(CASE WHEN count(*) > 1 THEN -sum(c / t * log2(c / t)) / log2(count(*)) ELSE 0 END, 6) AS norm_entropy
        FROM (SELECT y, k, count(*) * 1.0 AS c, sum(count(*)) OVER (PARTITION BY y) AS t FROM labelled GROUP BY y, k) GROUP BY y""",
        "labelled",
    ),
)
def agg12(spark, sf):
    l = V.labelled(spark, sf).withColumn("y", F.col("y").cast("long"))
    return rounded(audit.norm_entropy(l, "k", ["y"]))


@query(
    "agg13_field_diversity",
    V.check_sql(
        """SELECT CAST(y AS BIGINT) AS y, any_value(nt) AS n_total, CAST(sum(c) AS BIGINT) AS n_with_field,
          round(100.0 * sum(c) / any_value(nt), 6) AS coverage_pct, count(*) AS n_distinct,
          round(sum(c) FILTER (place <= 1) / sum(c), 6) AS top1_share, round(sum(c) FILTER (place <= 3) / sum(c), 6) AS top3_share,
          round(-sum(c / t * log2(c / t)) / log2(count(*)), 6) AS norm_entropy,
          string_agg(url, '|' ORDER BY place) FILTER (place <= 5) AS top_values
        FROM (SELECT y, url, c, sum(c) OVER (PARTITION BY y) AS t, row_number() OVER (PARTITION BY y ORDER BY c DESC, url) AS place
          FROM (SELECT y, url, count(*) * 1.0 AS c FROM labelled_detailed WHERE url IS NOT NULL GROUP BY y, url))
        JOIN (SELECT y, count(*) AS nt FROM labelled_detailed GROUP BY y) USING (y) GROUP BY y""",
        "labelled_detailed",
    ),
)
def agg13(spark, sf):
    l = V.labelled(spark, sf, detail=True).withColumn("y", F.col("y").cast("long"))
    return rounded(audit.diversity(l.select("y", "url"), "url"))


@query(
    "agg14_value_overlap",
    V.check_sql(
        """SELECT count(*) FILTER (a > 0 AND b > 0) AS n_shared, count(*) FILTER (a > 0) AS n_attack_values,
        count(*) FILTER (b > 0) AS n_benign_values, round(100.0 * sum(CASE WHEN b > 0 THEN a END) / sum(a), 6) AS attack_shared_pct,
        round(100.0 * sum(CASE WHEN a > 0 THEN b END) / sum(b), 6) AS benign_shared_pct
        FROM (SELECT url, sum(y) AS a, count(*) - sum(y) AS b FROM labelled_detailed WHERE url IS NOT NULL GROUP BY url)""",
        "labelled_detailed",
    ),
)
def agg14(spark, sf):
    return rounded(audit.value_overlap(V.labelled(spark, sf, detail=True), "url"))


@query(
    "agg15_field_coverage",
    V.check_sql(
        """SELECT collection, round(100.0 * count(url) / count(*), 6) AS url_pct, round(100.0 * count(path) / count(*), 6) AS path_pct,
        round(100.0 * count(srcuser) / count(*), 6) AS srcuser_pct, count(*) AS n FROM detailed GROUP BY collection""",
        "detailed",
    ),
)
def agg15(spark, sf):
    return rounded(audit.coverage(V.detailed_alerts(spark, sf), ["url", "path", "srcuser"], ["collection"]))


_MAPPED = "SELECT *, rule_id IN ({rules}) OR event_type IN ('error', 'view', 'click') OR (event_type = 'purchase' AND level >= 8) OR (event_type = 'signup' AND level >= 8) OR (event_type = 'signup' AND level = 5) AS mapped FROM detailed".format(
    rules=", ".join(f"'{r}'" for r in C.RULE_CLASSES)
)


@query(
    "agg16_mapping_coverage",
    V.check_sql(
        """SELECT collection, count(*) AS total, count(*) FILTER (mapped) AS clean, count(*) FILTER (NOT mapped) AS other,
        round(100.0 * count(*) FILTER (mapped) / count(*), 1) AS clean_pct FROM m GROUP BY collection""",
        "detailed", m=_MAPPED,
    ),
)
def agg16(spark, sf):
    return audit.mapping_coverage(V.detailed_alerts(spark, sf), "rule_id", "rule_groups", ["collection"])


@query(
    "agg16_top_unmapped_rules",
    V.check_sql(
        "SELECT rule_id, count(*) AS n FROM m WHERE NOT mapped GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 10",
        "detailed", m=_MAPPED,
    ),
)
def agg16_top(spark, sf):
    return audit.top_unmapped(V.detailed_alerts(spark, sf), "rule_id", "rule_groups")


@query(
    "agg17_top_attack_signature",
    V.check_sql(
        """SELECT signature, count(*) AS n, round(count(*) * 1.0 / (SELECT sum(y) FROM labelled), 6) AS share FROM labelled
        WHERE y = 1 GROUP BY signature ORDER BY n DESC, signature LIMIT 1""",
        "labelled",
    ),
)
def agg17(spark, sf):
    return rounded(audit.top_signature_share(V.labelled(spark, sf), "signature"))


_XRULES = ("5710", "5712", "554", "31101", "31151", "5901", "5902")


@query(
    "agg18_technique_rule_crosstab",
    V.check_sql(
        "SELECT coalesce(technique, '-') AS technique, "
        + ", ".join(f"count(*) FILTER (rule_id = '{r}') AS n_{r}" for r in _XRULES)
        + " FROM labelled GROUP BY 1",
        "labelled",
    ),
)
def agg18(spark, sf):
    l = V.labelled(spark, sf, carry=["technique"]).withColumn("technique", F.coalesce("technique", F.lit("-")))
    return audit.crosstab(l, "technique", "rule_id", _XRULES)


_PATH_TECH = """SELECT *, CASE WHEN event_type = 'view' THEN CASE k % 8 WHEN 0 THEN 'T1053.003' WHEN 2 THEN 'T1136.001'
    WHEN 3 THEN 'T1098.004' WHEN 5 THEN 'T1546.004' WHEN 6 THEN 'UNMAPPED_COL_ARTIFACT' END END AS path_technique
    FROM labelled_detailed WHERE y = 1"""


def _verified(spark, sf):
    l = V.labelled(spark, sf, detail=True, carry=["technique"])
    l = l.select("row_id", "us", "y", "rule_id", "technique", "path")
    return l.filter("y = 1").withColumn("path_technique", flags.artifact_technique(F.col("path")))


@query(
    "agg18_path_agreement",
    V.check_sql(
        """SELECT count(*) AS n, count(*) FILTER (path_technique = technique) AS agree,
        round(100.0 * count(*) FILTER (path_technique = technique) / count(*), 6) AS agree_pct FROM p
        WHERE path_technique <> 'UNMAPPED_COL_ARTIFACT'""",
        "labelled_detailed", p=_PATH_TECH,
    ),
)
def agg18_agreement(spark, sf):
    v = _verified(spark, sf).filter(F.col("path_technique") != C.UNMAPPED_ARTIFACT)
    return rounded(audit.agreement(v, "path_technique", "technique"))


_EXPECTED = "SELECT * FROM (VALUES " + ", ".join(
    "('{0}', [{1}])".format(r, ", ".join(f"'{t}'" for t in sorted(ts))) for r, ts in C.EXPECTED_TECHNIQUES.items()
) + ") AS e(rule_id, allowed)"
_BAD = """SELECT *, coalesce(truth, array_to_string(allowed, '/')) AS true_technique FROM (SELECT p.*, allowed,
    CASE WHEN list_contains(allowed, path_technique) THEN path_technique END AS truth FROM p JOIN expected USING (rule_id))
    WHERE CASE WHEN truth IS NOT NULL THEN technique <> truth ELSE NOT list_contains(allowed, technique) END"""


@query(
    "agg19_contradictions",
    V.check_sql(
        "SELECT rule_id, technique, true_technique, count(*) AS n FROM bad GROUP BY ALL",
        "labelled_detailed", p=_PATH_TECH, expected=_EXPECTED, bad=_BAD,
    ),
)
def agg19(spark, sf):
    return audit.contradiction_counts(audit.contradictions(_verified(spark, sf)))


@query(
    "agg20_constant_offset_test",
    V.check_sql(
        """SELECT technique, count(d) AS n, round(min(d), 6) AS min_s, round(max(d), 6) AS max_s,
          round(list_sort(list(d))[len(list(d)) // 2 + 1], 6) AS median_s, round(max(d) - min(d), 6) AS spread_s,
          CASE WHEN max(d) - min(d) <= 5 THEN 'CONSTANT' ELSE 'VARIABLE' END AS verdict
        FROM (SELECT bad.row_id, bad.technique, (CASE WHEN bad.us BETWEEN w.start_us AND w.end_us THEN 0
            WHEN bad.us > w.end_us THEN bad.us - w.end_us ELSE bad.us - w.start_us END) / 1000000.0 AS d
          FROM bad JOIN windows w ON w.technique = bad.true_technique
          QUALIFY row_number() OVER (PARTITION BY bad.row_id ORDER BY abs(d), d DESC) = 1)
        GROUP BY technique""",
        "labelled_detailed", p=_PATH_TECH, expected=_EXPECTED, bad=_BAD,
    ),
)
def agg20(spark, sf):
    bad = staged(
        audit.contradictions(_verified(spark, sf)).select("row_id", "us", "technique", "true_technique")
    )
    w = V.windows(spark, sf).select(F.col("technique").alias("true_technique"), "start_us", "end_us")
    near = staged(labels.nearest_window_offset(bad, w, ["true_technique"]).filter("offset_s IS NOT NULL"))
    return rounded(audit.offset_test(near, "offset_s", by=["technique"]))


_SPOT = {"5710": "T1110.001", "5712": "T1110.001", "31101": "T1595.003", "5901": "T1136.001"}


@query(
    "agg21_spot_checks",
    V.check_sql(
        """SELECT rule_id, expected, count(*) AS n, count(*) FILTER (technique = expected) AS hits,
        CASE WHEN count(*) FILTER (technique = expected) = count(*) THEN 'PASS' ELSE 'FAIL' END AS verdict
        FROM (SELECT * FROM labelled WHERE y = 1) JOIN (VALUES """
        + ", ".join(f"('{r}', '{t}')" for r, t in _SPOT.items())
        + ") AS c(rule_id, expected) USING (rule_id) GROUP BY rule_id, expected",
        "labelled",
    ),
)
def agg21(spark, sf):
    return audit.spot_check(V.labelled(spark, sf, carry=["technique"]).filter("y = 1"), _SPOT)


@query(
    "agg22_dataset_characterisation",
    V.check_sql(
        """SELECT rule_id, n, n_attack, n_descriptions, modal_description, round(100.0 * n_attack / n, 6) AS attack_share_pct FROM
        (SELECT rule_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_attack, count(DISTINCT text) AS n_descriptions FROM t GROUP BY 1
          ORDER BY n DESC, rule_id LIMIT 10)
        JOIN (SELECT rule_id, text AS modal_description FROM (SELECT rule_id, text, count(*) AS c FROM t GROUP BY 1, 2)
          QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY c DESC, text) = 1) USING (rule_id)""",
        "labelled_detailed",
        t="SELECT *, description || ' ' || CAST(k % 3 AS VARCHAR) AS text FROM labelled_detailed",
    ),
)
def agg22(spark, sf):
    l = V.labelled(spark, sf, detail=True).withColumn("text", F.concat_ws(" ", "description", F.col("k") % 3))
    return rounded(audit.characterise(l, "rule_id", "text"))


@query(
    "jn14_first_description",
    V.check_sql(
        """SELECT rule_id, arg_min(text, row_id) AS description FROM t GROUP BY rule_id""",
        "detailed",
        t="SELECT *, description || ' ' || CAST(k % 3 AS VARCHAR) AS text FROM detailed",
    ),
)
def jn14(spark, sf):
    d = V.detailed_alerts(spark, sf).withColumn("text", F.concat_ws(" ", "description", F.col("k") % 3))
    return audit.first_description(d, "rule_id", "text", "row_id")


_RATE10 = """SELECT l.*, n.rn - min(n.rn) OVER (PARTITION BY n.collection ORDER BY n.us RANGE BETWEEN 600000000 PRECEDING
    AND CURRENT ROW) + 1 AS rate FROM labelled l JOIN (SELECT row_id, us, collection,
    row_number() OVER (PARTITION BY collection ORDER BY us, row_id) AS rn FROM alerts) n USING (row_id)"""


def _rated(spark, sf):
    labelled = V.labelled(spark, sf, stage=True)
    return trailing.trailing_count(labelled, ["collection"], "us", "row_id", 600)


@query(
    "agg23_class_rate_statistics",
    V.check_sql(
        """SELECT CAST(y AS BIGINT) AS y, count(*) AS n, round(avg(rate), 6) AS mean, quantile_cont(rate, 0.5) AS median,
        round(quantile_cont(rate, 0.9), 6) AS p90, round(quantile_cont(rate, 0.95), 6) AS p95, round(quantile_cont(rate, 0.99), 6) AS p99,
        CAST(max(rate) AS DOUBLE) AS max FROM r GROUP BY y""",
        "labelled", r=_RATE10,
    ),
)
def agg23(spark, sf):
    return rounded(audit.rate_stats(_rated(spark, sf).withColumn("y", F.col("y").cast("long")), "rate"))


@query(
    "agg24_class_medians",
    V.check_sql(
        " UNION ALL ".join(
            f"SELECT CAST(y AS BIGINT) AS y, '{c}' AS feature, count(*) AS n, round(median(CAST({c} AS DOUBLE)), 6) AS median FROM labelled GROUP BY y"
            for c in ("value", "k", "level")
        ),
        "labelled",
    ),
)
def agg24(spark, sf):
    l = V.labelled(spark, sf).withColumn("y", F.col("y").cast("long"))
    return rounded(audit.class_medians(l, ("value", "k", "level"), ["y"]))


_PROFILE = ("value", "level", "kw_scan", "rare")


@query(
    "agg25_feature_profile",
    V.check_sql(
        " UNION ALL ".join(
            f"""SELECT collection, '{c}' AS feature, count(*) AS n, round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_pct,
            count(DISTINCT {c}) AS n_distinct, round(coalesce(var_samp({c}), 0.0), 6) AS variance,
            coalesce(var_samp({c}), 0) < 1e-9 OR count(DISTINCT {c}) <= 1 AS is_constant FROM p GROUP BY collection"""
            for c in _PROFILE
        ),
        "alerts", p="SELECT *, CASE WHEN k % 4 = 0 THEN k END AS rare FROM alerts",
    ),
)
def agg25(spark, sf):
    a = V.alerts(spark, sf).withColumn("rare", F.when(F.col("k") % 4 == 0, F.col("k")))
    return rounded(audit.feature_profile(a, _PROFILE, ["collection"]))


@query(
    "agg26_vector_collapse",
    V.check_sql(
        """SELECT collection, count(*) AS n, count(DISTINCT (level, k, kw_scan)) AS n_unique,
        round(count(DISTINCT (level, k, kw_scan)) * 1.0 / count(*), 6) AS unique_share FROM alerts GROUP BY collection""",
        "alerts",
    ),
)
def agg26(spark, sf):
    return rounded(audit.vector_collapse(V.alerts(spark, sf), ("level", "k", "kw_scan"), ["collection"]))


@query(
    "agg27_duplicate_unanimity",
    V.check_sql(
        """SELECT count(*) FILTER (c >= 2) AS n_groups, count(*) FILTER (h > 0 AND h < c) AS n_split,
        CAST(coalesce(sum(c) FILTER (h > 0 AND h < c), 0) AS BIGINT) AS rows_in_split
        FROM (SELECT count(*) AS c, sum(y) AS h FROM labelled GROUP BY level, k, event_type)""",
        "labelled",
    ),
)
def agg27(spark, sf):
    return audit.duplicate_unanimity(V.labelled(spark, sf), ("level", "k", "event_type"), "y")


@query(
    "agg28_detected_vs_missed_medians",
    V.check_sql(
        " UNION ALL ".join(
            f"SELECT collection, CAST(pred AS BIGINT) AS pred, '{c}' AS feature, count(*) AS n, round(median(CAST({c} AS DOUBLE)), 6) AS median FROM scored WHERE y = 1 GROUP BY ALL"
            for c in ("value", "k")
        ),
        "labelled", maj=_MAJ, scored=_SCORED,
    ),
)
def agg28(spark, sf):
    s = _scored(spark, sf).filter("y = 1").withColumn("pred", F.col("pred").cast("long"))
    return rounded(audit.class_medians(s, ("value", "k"), ["collection", "pred"]))


@query(
    "agg29_run_summary",
    V.check_sql(
        """SELECT collection, count(*) AS runs, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(min(m), 6) AS min,
        round(max(m), 6) AS max, round(avg(m) - 1.96 * stddev_samp(m) / sqrt(count(*)), 6) AS ci_low,
        round(avg(m) + 1.96 * stddev_samp(m) / sqrt(count(*)), 6) AS ci_high, round(avg(m) - 50, 6) AS gap
        FROM (SELECT collection, k % 10 AS run, avg(value) AS m FROM alerts GROUP BY ALL) GROUP BY collection""",
        "alerts",
    ),
)
def agg29(spark, sf):
    runs = V.alerts(spark, sf).groupBy("collection", (F.col("k") % 10).alias("run")).agg(F.avg("value").alias("m"))
    return rounded(audit.run_summary(runs, "m", ["collection"], baseline=50.0))


@query(
    "agg30_wilson_interval",
    V.check_sql(
        """SELECT signature, n, n_attack, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low,
        round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high
        FROM (SELECT signature, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_attack, avg(y) AS p, 1.959963984540054::DOUBLE AS z FROM labelled GROUP BY 1)""",
        "labelled",
    ),
)
def agg30(spark, sf):
    low, high = wilson(F.col("n_attack"), F.col("n"))
    t = audit.fit_lookup(V.labelled(spark, sf), "signature")
    return t.select("signature", "n", "n_attack", F.round(F.abs(low), 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "agg31_value_histogram",
    V.check_sql(
        """SELECT CAST(y AS BIGINT) AS y, least(rate, 20) AS bin, count(*) AS n,
        round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS pct FROM r GROUP BY y, least(rate, 20)""",
        "labelled", r=_RATE10,
    ),
)
def agg31(spark, sf):
    return rounded(audit.histogram(_rated(spark, sf).withColumn("y", F.col("y").cast("long")), "rate"))


@query(
    "agg32_composition",
    V.check_sql(
        """SELECT CASE WHEN place <= 5 THEN rule_id ELSE 'other' END AS rule, CAST(sum(n) AS BIGINT) AS n,
        round(100.0 * sum(n) / (SELECT count(*) FROM alerts), 6) AS pct FROM (SELECT rule_id, count(*) AS n,
        row_number() OVER (ORDER BY count(*) DESC, rule_id) AS place FROM alerts GROUP BY rule_id) GROUP BY 1""",
        "alerts",
    ),
)
def agg32(spark, sf):
    return rounded(audit.composition(V.alerts(spark, sf), "rule_id"))


@query(
    "agg33_attack_type_breakdown",
    V.check_sql(
        """SELECT technique, rule_id, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY technique) AS BIGINT) AS n_type,
        round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY technique), 6) AS pct_of_type
        FROM labelled WHERE y = 1 GROUP BY technique, rule_id""",
        "labelled",
    ),
)
def agg33(spark, sf):
    return rounded(audit.type_breakdown(V.labelled(spark, sf, carry=["technique"]), "technique", "rule_id"))


_TIERS = dict(baselines=_BASELINES, hits=_HITS, tiers=_TIERED_LINUX)


@query(
    "agg34_label_tier_summary",
    V.check_sql(
        f"""SELECT coalesce(label, 'ALL') AS label, coalesce(label_confidence, 'ALL') AS label_confidence, count(*) AS n
        FROM (SELECT label_confidence, {_LABEL} FROM tiers) GROUP BY ROLLUP (label, label_confidence)""",
        "detailed", "windows", **_TIERS,
    ),
)
def agg34(spark, sf):
    return audit.label_summary(linux_tiers(spark, sf))


@query(
    "agg34_residual_ratio",
    V.check_sql(
        f"""SELECT count(*) FILTER (label = 'attack') AS n_attack, count(*) FILTER (label_confidence LIKE 'HIGH%') AS n_high,
        count(*) FILTER (label_confidence LIKE '%LOW-time') AS n_low, count(*) FILTER (label = 'uncertain') AS n_uncertain,
        round((count(*) FILTER (label_confidence LIKE '%LOW-time') + count(*) FILTER (label = 'uncertain')) * 1.0
          / count(*) FILTER (label = 'attack'), 6) AS residual FROM (SELECT label_confidence, {_LABEL} FROM tiers)""",
        "detailed", "windows", **_TIERS,
    ),
)
def agg34_residual(spark, sf):
    return rounded(audit.residual_ratio(linux_tiers(spark, sf)))


@query(
    "agg34_tier_split_per_technique",
    V.check_sql(
        f"""SELECT technique, count(*) AS n, count(*) FILTER (label_confidence LIKE 'HIGH%') AS n_high,
        count(*) FILTER (label_confidence NOT LIKE 'HIGH%') AS n_lower FROM (SELECT label_confidence, {_LABEL} FROM tiers)
        WHERE label = 'attack' GROUP BY technique""",
        "detailed", "windows", **_TIERS,
    ),
)
def agg34_split(spark, sf):
    return audit.tier_split(linux_tiers(spark, sf))


_HITS3 = "SELECT *, CAST(value >= 60 AS INT) AS a, CAST(level >= 8 AS INT) AS b, CAST(k >= 50 AS INT) AS c FROM labelled WHERE y = 1"


@query(
    "agg35_detection_set_agreement",
    V.check_sql(
        """SELECT count(*) FILTER (a + b + c = 3) AS n_all, count(*) FILTER (a + b + c > 0) AS n_any,
        count(*) FILTER (a <> b) = 0 AS same_a_b, count(*) FILTER (a <> c) = 0 AS same_a_c, count(*) FILTER (b <> c) = 0 AS same_b_c,
        count(*) FILTER (a = 1 AND b + c = 0) AS only_a, count(*) FILTER (b = 1 AND a + c = 0) AS only_b,
        count(*) FILTER (c = 1 AND a + b = 0) AS only_c FROM h""",
        "labelled", h=_HITS3,
    ),
)
def agg35(spark, sf):
    h = V.labelled(spark, sf).filter("y = 1").selectExpr(
        "CAST(value >= 60 AS INT) AS a", "CAST(level >= 8 AS INT) AS b", "CAST(k >= 50 AS INT) AS c"
    )
    return audit.set_agreement(h, ("a", "b", "c"))


@query(
    "agg36_false_positive_breakdown",
    V.check_sql(
        """SELECT rule_id, fp, n, round(100.0 * fp / n, 6) AS fpr_pct, round(100.0 * fp / sum(fp) OVER (), 6) AS share_pct,
        abs(round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6)) AS wilson_low,
        round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS wilson_high
        FROM (SELECT rule_id, count(*) FILTER (level >= 5) AS fp, count(*) AS n, count(*) FILTER (level >= 5) * 1.0 / count(*) AS p,
          1.959963984540054::DOUBLE AS z FROM labelled WHERE y = 0 GROUP BY rule_id)""",
        "labelled",
    ),
)
def agg36(spark, sf):
    l = V.labelled(spark, sf).withColumn("pred", (F.col("level") >= 5).cast("int"))
    t = rounded(audit.fp_breakdown(l, "rule_id"))
    return t.withColumn("wilson_low", F.abs("wilson_low"))


_IMPORTANCE = {"level": "rule_level", "value": "alert_rate_1min", "k": "unique_src_ip_10min",
               "kw_scan": "kw_scan", "kw_brute": "kw_brute", "auth_failure": "is_auth_failure"}


@query(
    "agg37_bucket_attribution",
    V.check_sql(
        """SELECT bucket, round(sum(mi), 6) AS gain, count(*) AS n_features, round(100.0 * sum(mi) / sum(sum(mi)) OVER (), 6) AS gain_pct,
        row_number() OVER (ORDER BY sum(mi) DESC) AS place FROM (SELECT mi, CASE WHEN feature = 'level' THEN 'identity'
        WHEN feature IN ('value', 'k') THEN 'behavioural' ELSE 'correlated' END AS bucket FROM mi) GROUP BY bucket""",
        "labelled", long=_LONG, mi=_MI,
    ),
)
def agg37(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in _IMPORTANCE.items() for x in kv])
    mi = audit.mi_rank(V.labelled(spark, sf), _MI_COLS).select(names[F.col("feature")].alias("feature"), F.col("mi").alias("gain"))
    b = rounded(audit.bucket_attribution(mi))
    return b.withColumn("place", F.col("place").cast("long"))


@query(
    "agg39_scenario_mix",
    V.check_sql(
        """SELECT scenario, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_attack, round(avg(y), 6) AS attack_rate
        FROM labelled WHERE level >= 8 GROUP BY scenario""",
        "labelled",
    ),
)
def agg39(spark, sf):
    return rounded(audit.scenario_mix(V.labelled(spark, sf).filter("level >= 8"), "scenario"))


@query(
    "agg40_single_feature_rule",
    V.check_sql(
        f"SELECT tp, fp, tn, fn, {_RATES} FROM (SELECT {_CELLS} FROM (SELECT *, CAST(rate >= 3 AS INT) AS pred FROM r))",
        "labelled", r=_RATE10,
    ),
)
def agg40(spark, sf):
    return rounded(audit.rule_score(_rated(spark, sf), F.col("rate") >= 3))


@query(
    "agg41_score_separation",
    V.check_sql(
        """SELECT collection, median(value) FILTER (y = 1) AS attack_median, round(median(value) FILTER (y = 0), 6) AS benign_median,
        round(quantile_cont(value, 0.75) FILTER (y = 1) - quantile_cont(value, 0.25) FILTER (y = 1), 6) AS attack_iqr,
        round(quantile_cont(value, 0.75) FILTER (y = 0) - quantile_cont(value, 0.25) FILTER (y = 0), 6) AS benign_iqr,
        CASE WHEN median(value) FILTER (y = 1) > median(value) FILTER (y = 0) THEN 'CORRECT' ELSE 'INVERTED' END AS separation
        FROM labelled GROUP BY collection""".replace("median(value) FILTER (y = 1) AS attack_median", "round(median(value) FILTER (y = 1), 6) AS attack_median"),
        "labelled",
    ),
)
def agg41(spark, sf):
    return rounded(audit.separation(V.labelled(spark, sf), "value", by=["collection"]))


@query(
    "agg43_detection_note",
    V.check_sql(
        """SELECT technique, n, round(r1, 6) AS l1_recall, round(r2, 6) AS l2_recall, round(e, 6) AS either_recall,
        CASE WHEN greatest(r1, r2) < 50 THEN 'found by neither layer' WHEN r1 >= r2 THEN 'known-attack layer carries over' ELSE 'anomaly layer leads' END AS note
        FROM (SELECT technique, count(*) AS n, 100.0 * sum(a) / count(*) AS r1, 100.0 * sum(c) / count(*) AS r2,
          100.0 * count(*) FILTER (a + c > 0) / count(*) AS e FROM h GROUP BY technique)""",
        "labelled", h=_HITS3,
    ),
)
def agg43(spark, sf):
    h = V.labelled(spark, sf, carry=["technique"]).filter("y = 1").selectExpr(
        "technique", "CAST(value >= 60 AS INT) AS a", "CAST(k >= 50 AS INT) AS c"
    )
    return rounded(audit.detection_note(h, "technique", "a", "c"))


@query(
    "agg44_pipelines_equal",
    V.check_sql(
        """SELECT collection, count(*) AS n, count(*) FILTER (raw <> prod) AS n_different, count(*) FILTER (raw <> prod) = 0 AS equal
        FROM (SELECT collection, level >= 5 AS raw, level >= 5 AND NOT (rule_id IN ('31101', '31151', '5710', '5501') AND scenario % 4 = 0) AS prod
          FROM alerts) GROUP BY collection""",
        "alerts",
    ),
)
def agg44(spark, sf):
    a = V.alerts(spark, sf).withColumn("raw", F.col("level") >= 5)
    deferred = F.col("rule_id").isin(*C.DEFERRED_RULES) & (F.col("scenario") % 4 == 0)
    return audit.pipelines_equal(a.withColumn("prod", F.col("raw") & ~deferred), "raw", "prod", ["collection"])
