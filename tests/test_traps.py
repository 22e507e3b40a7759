"""Hand-made fixtures for the semantic traps, and golden arithmetic from published counts."""

import pytest
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions import flags, stats, timeparse, weblog
from sentrylens.operators import audit, controls, decisions, features, history, labels, rounds, splits
from sentrylens.operators import thresholds as T

S = 1_000_000


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


# --- golden arithmetic -----------------------------------------------------------------------


def test_wilson_interval_of_ten_in_209(spark):
    low, high = stats.wilson(F.lit(10), F.lit(209))
    r = one(spark, low=low, high=high)
    assert (round(100 * r.low, 1), round(100 * r.high, 1)) == (2.6, 8.6)


def test_trivial_f1_of_base_rate(spark):
    df = spark.range(10_000).select((F.col("id") < 7466).cast("int").alias("y"))
    assert round(audit.trivial_baseline(df).first().trivial_f1, 4) == 0.8549


def test_tempo_ratio_of_two_collections(spark):
    attack, benign = 23_081 / 2_580.69, 267 / 4_037.06
    r = one(spark, ratio=F.lit(attack / benign), flag=controls.tempo_flag(F.lit(attack / benign), F.lit(1.0)))
    assert round(r.ratio, 1) == 135.2 and r.flag


def test_rates_of_counts_and_empty_classes(spark):
    r = one(spark, **stats.rates(F.lit(3), F.lit(1), F.lit(5), F.lit(1)))
    assert (r.precision, r.recall, r.f1, r.fpr, r.fnr) == (0.75, 0.75, 0.75, 1 / 6, 0.25)
    r = one(spark, **stats.rates(F.lit(0), F.lit(0), F.lit(5), F.lit(0)))
    assert r.precision is None and r.recall is None and r.f1 == 0.0 and r.fpr == 0.0


# --- history ---------------------------------------------------------------------------------


def _history(spark, rows):
    df = spark.createDataFrame(
        rows, "agent string, pos long, us long, level double, rule string, srcip string, auth boolean, scan boolean, brute boolean"
    )
    item = history.history_item(*[F.col(c) for c in ("us", "level", "rule", "srcip", "auth", "scan", "brute")])
    return {r.pos: r for r in history.agent_history(df, ["agent"], ["pos"], "us", item, target_rows=3).collect()}


def test_history_excludes_current_row_and_keeps_defaults(spark):
    h = _history(spark, [("a", 0, 0, 12.0, "r", "ip", True, True, True), ("a", 1, 5 * S, 3.0, "r", "", False, False, False)])
    assert (h[0].alert_rate_1min, h[0].time_since_last_high, h[0].high_sev_ratio_20) == (0, 999.0, 0)
    assert (h[1].alert_rate_1min, h[1].time_since_last_high, h[1].unique_src_ip_10min) == (1, 5.0, 1)
    assert h[1].scan_preceded == 1 and h[1].brute_preceded == 1 and h[1].failed_login_5min == 1


def test_history_null_and_future_rows_count_only_in_severity_share(spark):
    rows = [
        ("a", 0, None, 9.0, "r1", "i1", True, True, True),
        ("a", 1, 900 * S, 9.0, "r2", "i2", True, True, True),
        ("a", 2, 100 * S, 3.0, "r3", "i3", False, False, False),
        ("a", 3, None, 3.0, "r3", "i3", False, False, False),
    ]
    h = _history(spark, rows)
    assert h[2].high_sev_ratio_20 == 1.0
    assert (h[2].alert_rate_1min, h[2].rule_diversity_10min, h[2].scan_preceded) == (0, 0, 0)
    assert (h[3].high_sev_ratio_20, h[3].time_since_last_high) == (0.0, 999.0)


def test_history_levels_eight_and_ten_differ(spark):
    h = _history(spark, [("a", 0, 0, 8.0, "r", "i", False, False, False), ("a", 1, S, 1.0, "r", "i", False, False, False)])
    assert h[1].high_sev_ratio_20 == 1.0 and h[1].time_since_last_high == 999.0


def test_zero_elapsed_reads_as_never_in_the_normalised_row_only(spark):
    base = dict(level="12", rule_id="5710", description="d", rule_groups=["sshd"], tactics=["impact"], agent_name="x",
                srcip="i", command=None, message=None, full_log=None)
    rows = [{"pos": i, "us": 7 * S, **base} for i in range(2)]
    schema = ("pos long, us long, level string, rule_id string, description string, rule_groups array<string>, tactics array<string>, "
              "agent_name string, srcip string, command string, message string, full_log string")
    df = spark.createDataFrame(rows, schema)
    v2 = {r.pos: r for r in features.features_v2(df, ["agent_name"], ["us", "pos"], "us", keep=["pos"]).collect()}
    norm = {r.pos: r for r in features.features_norm(df, ["agent_name"], ["us", "pos"], "us", keep=["pos"]).collect()}
    assert v2[1].time_since_last_high == 0.0 and norm[1].time_since_last_high == 999.0
    assert v2[0].kill_chain_stage == 2.0 and norm[0].kill_chain_stage == 0.0
    assert list(v2[0].asDict()) == ["pos", *C.FEATURES] and list(norm[0].asDict()) == ["pos", *C.NORM_FEATURES]


# --- projections -----------------------------------------------------------------------------


def test_group_trigger_matches_inside_other_words(spark):
    c = one(spark, c=flags.classify_rule(F.lit("x"), F.array(F.lit("PortScan")))).c
    assert tuple(c) == (5, 5, 3, 2) and one(spark, m=flags.is_mapped(F.lit("x"), F.array(F.lit("PortScan")))).m
    assert not one(spark, m=flags.is_mapped(F.lit(None).cast("string"), F.lit(None).cast("array<string>"))).m


def test_adduser_is_an_authentication_failure_in_v2_only(spark):
    g = F.array(F.lit("AddUser"))
    r = one(spark, a=flags.is_auth_failure(g), b=flags.norm_is_auth_failure(g, F.lit(3)))
    assert (r.a, r.b) == (1.0, 0.0)


def test_first_mapped_tactic_wins(spark):
    t = F.array(F.lit("Nothing"), F.lit("Execution"), F.lit("Impact"))
    r = one(spark, t=flags.tactic_id(t), none=flags.tactic_id(F.lit(None).cast("array<string>")))
    assert (r.t, r.none) == (3.0, -1.0)


@pytest.mark.parametrize(
    "text, ok",
    [("2026-07-08T20:22:28Z", True), ("2026-07-08T20:22:28.000+0000", True), ("2026-07-08T23:22:28+03:00", True),
     ("2026-07-08T20:22:28", True), ("2026-07-08 20:22:28", True), ("yesterday", False), ("", False)],
)
def test_iso_variants(spark, text, ok):
    us = one(spark, us=timeparse.micros(timeparse.parse_iso(F.lit(text)))).us
    assert us == (1783542148 * S if ok else None)


def test_event_time_ignores_implausible_lag_and_deleted_files(spark):
    def source(event, mtime):
        t = timeparse.event_time(F.lit("x"), F.lit("2026-07-08T20:23:00Z"), F.lit(event), F.lit(mtime))
        return one(spark, t=t).t.time_source

    assert source("added", "2026-07-08T20:22:30") == "syscheck_mtime"
    assert source("added", "2026-07-08T20:22:50") == "alert_timestamp"
    assert source("deleted", "2026-07-08T20:22:30") == "alert_timestamp"


def test_access_lines_in_both_dialects(spark):
    line = '1.2.3.4 - - [08/Jul/2026:20:22:28 +0000] "GET /a/.b.php?x=1 HTTP/1.1" 404 12 "-" "curl/8"'
    r = one(spark, p=weblog.parse_access_line(F.lit(line)), v=weblog.parse_access_line(F.lit("h:80 " + line), True),
            bad=weblog.parse_access_line(F.lit("nope")))
    assert r.p == r.v and r.p.path == "/a/.b.php?x=1" and r.p.agent == "curl/8" and r.bad is None


def test_url_shapes_and_entropy(spark):
    f = weblog.url_features(F.lit("/"), F.lit("x"), F.lit("GET"))
    r = one(spark, d=f["path_depth"], s=f["status_code"], e=weblog.char_entropy(F.lit("aabb")), z=weblog.char_entropy(F.lit("")))
    assert (r.d, r.s, r.e, r.z) == (0, None, 1.0, 0.0)


# --- labels ----------------------------------------------------------------------------------


def test_asof_looks_at_the_latest_window_only(spark):
    w = spark.createDataFrame([("s", 0, 100), ("s", 10, 20), ("s", 10, 30)], "k string, start_us long, end_us long")
    a = spark.createDataFrame([("s", t) for t in (0, 5, 20, 25, 31, 50, None)], "k string, us long")
    asof = {r.us: r.y for r in labels.label_asof(a, w, ["k"]).collect()}
    assert asof == {0: 1, 5: 1, 20: 1, 25: 1, 31: 0, 50: 0, None: 0}
    anyw = {r.us: r.y for r in labels.label_contains(a, w, ["k"]).collect()}
    assert anyw == {0: 1, 5: 1, 20: 1, 25: 1, 31: 1, 50: 1, None: 0}


def test_fixed_windows_without_join(spark):
    a = spark.createDataFrame([(1,), (5,), (9,)], "us long")
    got = {r.us: (r.y, r.y_name) for r in labels.label_fixed_windows(a, [(0, 5, "p"), (5, 6, "q")]).collect()}
    assert got == {1: (1, "p"), 5: (1, "p"), 9: (0, "")}


def test_periodicity_needs_five_gaps(spark):
    df = spark.createDataFrame([("a", i, i * 10 * S) for i in range(6)] + [("b", i, i * 10 * S) for i in range(5)], "k string, id long, us long")
    p = {r.k: r.is_periodic for r in rounds.periodicity(df, ["k"], "us", "id").collect()}
    assert p == {"a": True, "b": False}


# --- audit -----------------------------------------------------------------------------------


def test_lookup_ties_to_attack_and_unseen_to_benign(spark):
    train = spark.createDataFrame([("t", 1), ("t", 0), ("b", 0)], "sig string, y int")
    test = spark.createDataFrame([("t", 0), ("b", 1), ("new", 1)], "sig string, y int")
    p = {r.sig: r.pred for r in audit.apply_lookup(test, audit.fit_lookup(train, "sig"), "sig").collect()}
    assert p == {"t": 1, "b": 0, "new": 0}


def test_single_class_population(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "sig string, y int, v double")
    assert audit.nmi(df, "sig", "y").first().nmi == pytest.approx(0.0)
    assert audit.trivial_baseline(df).first().trivial_f1 == 0.0
    assert controls.burst_overlap(df, "v").first().verdict == "FAIL"


def test_band_table_lists_empty_bands(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "sig string, y int")
    bands = audit.purity_bands(audit.purity(df, "sig")).collect()
    assert len(bands) == 6 and bands[0].n_sig == 2 and sum(b.volume for b in bands) == 2
    cumulative = {b.band: b.n_sig for b in audit.ratio_bands(audit.ratio_table(df, "sig")).collect()}
    assert cumulative == {">=1000": 1, ">=100": 1, ">=10": 1, ">=2": 1, "exclusive": 1}


# --- thresholds and splits -------------------------------------------------------------------


def test_thresholds_on_a_small_score_table(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.6), (1, 0.5), (1, 0.9)], "y int, score double")
    curve = T.score_curve(df, "score", target_rows=2)
    r = T.recall_at_fpr(curve, 0.0).first()
    assert (r.recall, r.achieved_fpr, r.threshold) == (0.5, 0.0, 0.9)
    assert T.recall_at_fpr(curve.filter("threshold < 0.2"), 0.0).first().threshold == float("inf")
    best = T.max_f1(curve).first()
    assert best.threshold == 0.5 and round(best.f1, 3) == 0.8
    grid = T.grid_curve(df, "score", [0.0, 0.5, 0.55, 1.0])
    cost = T.cost_optimal(grid).first()
    assert (cost.threshold, cost.cost) == (0.5, 1)
    assert T.zero_fn(grid).first().threshold == 0.5
    zero = T.max_f1(T.grid_curve(df.filter("y = 0"), "score", [0.5]), fallback=0.5).first()
    assert (zero.f1, zero.threshold) == (0.0, 0.5)


def test_splits_truncate_or_round_half_even(spark):
    df = spark.range(9).select(F.col("id"), F.col("id").alias("us"), F.lit(0).alias("y"))
    assert splits.temporal_split(df, "us", "id").filter("split = 'train'").count() == 7  # int(7.2)
    tail = splits.class_tail_split(df.filter("id < 5"), "y", "us", "id", 0.5)
    assert tail.filter("split = 'test'").count() == 2  # round(2.5)
    assert splits.class_tail_split(df.limit(1), "y", "us", "id").first().split == "test"
    a = splits.stratified_split(df, "y", "id")
    assert splits.split_differences(a, splits.stratified_split(df.repartition(3), "y", "id"), ["id", "split"]).isEmpty()


def test_upsample_reaches_the_majority_size(spark):
    df = spark.range(11).select("id", (F.col("id") < 3).cast("int").alias("y"))
    n = {r.y: r["count"] for r in splits.upsample(df, "y", "id").groupBy("y").count().collect()}
    assert n == {0: 8, 1: 8}


# --- decisions -------------------------------------------------------------------------------


def test_two_layer_decision_and_deferral(spark):
    rows = [(0.9, 0.0, "31101", 1.0), (0.9, 0.0, "31101", 3.0), (0.9, 0.9, "31101", 1.0), (0.1, 0.9, "x", 1.0), (0.1, 0.1, "x", 1.0)]
    df = spark.createDataFrame(rows, "s1 double, s2 double, rule string, crit double")
    d = decisions.two_layer(F.col("s1"), F.col("s2"), 0.5, 0.5, decisions.defers(F.col("rule"), F.col("crit")))
    got = [r.decision for r in df.select(d["decision"].alias("decision")).collect()]
    assert got == ["suppress", "forward", "suspicious", "suspicious", "suppress"]


def test_zeroed_block_keeps_the_documented_default(spark):
    df = spark.createDataFrame([(5.0, 5.0)], "time_since_last_high double, alert_rate_1min double")
    r = decisions.zeroed(df, ["time_since_last_high", "alert_rate_1min"]).first()
    assert tuple(r) == (999.0, 0.0)


# --- controls --------------------------------------------------------------------------------


def test_capped_burst_ignores_ranges_unless_strict(spark):
    df = spark.createDataFrame([(1, 9.0), (1, 8.0), (0, 1.0), (0, 2.0)], "y int, v double")
    assert controls.burst_overlap(df, "v").first().verdict == "FAIL"
    assert controls.burst_overlap(df, "v", cap=20).first().verdict == "PASS"
    assert controls.burst_overlap(df, "v", cap=20, strict_spec=True).first().verdict == "FAIL"
    assert controls.burst_overlap(df, "v", cap=8).first().verdict == "FAIL"


def test_rule_that_dominates_benign_only_needs_strict(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (0, "z"), (0, "z")], "y int, rule string")
    assert controls.rule_composition(df, "rule").first().verdict == "PASS"
    strict = controls.rule_composition(df, "rule", strict_spec=True).first()
    assert (strict.verdict, strict.dominant_rule) == ("FAIL", "z")


def test_empty_claims_pass_and_missing_table_fails(spark):
    registry = spark.createDataFrame([("a",)], "path string")
    empty = spark.createDataFrame([], "claim_id long, source_file string")
    assert controls.claim_provenance(empty, registry).first().verdict == "PASS"
    assert controls.claim_provenance(None, registry).first().verdict == "FAIL"
    claims = spark.createDataFrame([(1, "a; "), (2, "a;b"), (3, None)], "claim_id long, source_file string")
    r = controls.claim_provenance(claims, registry).first()
    assert (r.n_claims, r.n_missing, r.verdict) == (3, 2, "FAIL")


def test_settings_runner_reports_a_flip(spark):
    def run(settings):
        return spark.createDataFrame([(k, v, 0.5) for k, v in settings.items() if v], "setting string, verdict string, metric double")

    runs = controls.run_settings({"default": "x", "other": "y"}, run)
    r = controls.verdict_stability(runs, "verdict").first()
    assert (r.n_settings, r.n_verdicts, r.verdict) == (2, 2, "FAIL")
    assert sorted(x.setting for x in runs.collect()) == ["default", "other"]
    # a setting that gives no verdict is not a stable one
    lost = controls.run_settings({"default": "x", "other": None}, run)
    assert controls.verdict_stability(lost, "verdict").first().verdict == "FAIL"
    same = controls.run_settings({"default": "x", "other": "x"}, run)
    assert controls.verdict_stability(same, "verdict").first().verdict == "PASS"


def test_tier_orders(spark):
    cols = "n_hits long, hit_technique string, in_baseline boolean, art boolean, exact boolean, sess boolean, tree boolean"
    rows = [(1, "T", True, True, True, True, False), (1, "T", False, False, False, True, True), (2, None, True, True, True, True, True),
            (0, None, True, True, True, True, False), (0, None, True, False, False, True, False), (0, None, False, False, True, False, False)]
    df = spark.createDataFrame(rows, cols)
    lin = labels.tier_linux(df, F.col("art"), F.col("exact"), F.col("sess")).collect()
    assert [r.label_confidence for r in lin] == ["LOW-time", "VLOW-time", "UNCERTAIN-overlap", "UNCERTAIN-artifact-teardown",
                                                 "BENIGN-baseline-weak", "UNCERTAIN-out-of-session"]
    win = labels.tier_windows(df, F.col("tree"), F.lit(False), F.lit(False)).collect()
    assert [r.label_confidence for r in win] == ["LOW-time", "HIGH-process", "HIGH-process-overlap", "BENIGN-baseline", "BENIGN-baseline",
                                                 "UNCERTAIN-session-gap"]
    assert [r.technique for r in win] == ["T", "T", "MULTI", "", "", ""]
