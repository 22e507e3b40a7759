"""Registry rules, and a cross-section of the queries against their SQL at the smallest scale.

The whole registry is compared by ``tools/check.py``.
"""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from sentrylens.plans.catalog import CHECKS, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "audit_lookup_vs_trivial", "prj5_event_time_cascade", "prj15_semantic_class", "prj14_feature_row_26", "src1_json_lines_scan",
    "jn1_label_asof", "jn3_first_window_technique", "jn5_linux_label_tiers", "jn8_transitive_closure", "jn9_pair_markers_fifo",
    "win1_agent_history", "win4_trailing_count", "win9_stage_flags", "win13_rounds", "agg6_purity_bands", "agg10_nmi",
    "agg11_mutual_information_rank", "agg23_class_rate_statistics", "spl1_stratified_split", "spl3_temporal_split",
    "thr1_cost_curve_optimum", "thr4_recall_at_fpr_budget", "mod11_model_comparison_matrix", "cfx1_swap_to_benign_medians",
    "ctl4_verdict_stability", "ctl6_missing_claims", "ctl8_control_matrix", "e1_training_run", "src2_scenario_from_file_name",
    "mod1_boosted_stumps_scores", "mod1_boosted_trees_scores", "thr11_roc_auc_per_collection", "prj26_identity_codes",
)


def inventory():
    ids = {"PRJ": 30, "FLT": 9, "JN": 16, "AGG": 44, "WIN": 17, "SPL": 9, "MOD": 13, "THR": 10, "CFX": 6, "CTL": 9, "SRC": 10,
           "SNK": 3, "SET": 3, "SRT": 3, "STR": 2, "PRE": 1}
    return {f"{k}{i}".lower() for k, n in ids.items() for i in range(1, n + 1)}


def test_every_inventory_id_has_a_query():
    covered = {re.match(r"[a-z]+\d+", n).group() for n in QUERIES if re.match(r"[a-z]+\d+_", n)}
    assert inventory() - covered == set()


def test_every_query_has_sql():
    assert {n for n in QUERIES if n not in CHECKS} == set()


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    from check import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    from check import rows_of

    got = rows_of(QUERIES[name](spark, SF).toPandas())
    want = rows_of(db.execute(CHECKS[name]).df())
    assert got == want
