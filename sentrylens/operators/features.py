"""Feature rows: the 26-column row, the normalised 22-column row and the mapper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions import flags
from sentrylens.operators.history import agent_history, history_item
from sentrylens.session import staged

HISTORY_FEATURES = (
    "alert_rate_1min", "failed_login_5min", "unique_src_ip_10min", "high_sev_ratio_20",
    "rule_diversity_10min", "time_since_last_high", "scan_preceded", "brute_preceded",
)
# columns of a flat alert row, as sources.alerts.flatten gives them
ALERT_FIELDS = (
    "level", "rule_id", "description", "rule_groups", "tactics", "agent_name", "srcip", "command",
    "message", "full_log",
)


def alert_projection(df: DataFrame) -> DataFrame:
    """All features of an alert that need no history, next to its own columns."""
    text = flags.combined_text(
        F.col("description"), F.col("full_log"), F.col("command"), F.col("message"), F.col("tactics")
    )
    out = df.withColumn("_text", text)
    out = out.withColumns(
        {
            "desc_len": F.length(flags.text_or_empty(F.col("description"))).cast("double"),
            "rule_level": flags.number_or_zero(F.col("level")),
            **flags.keyword_flags(F.col("_text")),
            "mitre_tactic_id": flags.tactic_id(F.col("tactics")),
            "is_auth_failure": flags.is_auth_failure(F.col("rule_groups")),
            "is_web_attack": flags.is_web_attack(F.col("rule_groups"), F.col("description")),
            "rule_id_encoded": flags.rule_id_code(F.col("rule_id")),
            "agent_criticality": flags.agent_criticality(F.col("agent_name")),
        }
    )
    return out.withColumn("kill_chain_stage", flags.kill_chain_stage(F.col("mitre_tactic_id"))).drop("_text")


def features_v2(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, keep: Sequence[str] = (), **kw
) -> DataFrame:
    """PRJ14: the 26 features in their fixed order (``keep`` columns first).

    The texts are read once: their numeric features are staged, and only these travel
    through the history's shuffle.
    """
    needed = [c for c in dict.fromkeys((*keep, *keys, *order, time, "rule_id", "srcip"))]
    own = [f for f in C.FEATURES if f not in HISTORY_FEATURES]
    projected = staged(alert_projection(df).select(*needed, *own))
    item = history_item(
        F.col(time), F.col("rule_level"), F.col("rule_id"), F.col("srcip"),
        F.col("is_auth_failure") > 0, F.col("kw_scan") > 0, F.col("kw_brute") > 0,
    )
    return agent_history(projected, keys, order, time, item, **kw).select(*keep, *C.FEATURES)


def features_norm(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, keep: Sequence[str] = (),
    process_depth: Column | None = None, **kw,
) -> DataFrame:
    """PRJ18: the 22 normalised features.

    Quirks kept: an elapsed time of exactly 0 s reads as "no recent alert" (999), and
    the stage is 0 because a history never supplies it.
    """
    text = F.array_join(
        F.array(*[flags.text_or_empty(F.col(c)) for c in ("description", "full_log", "command")]), " "
    )
    base = alert_projection(df)
    level = flags.number_or_zero(F.col("level"))
    c = flags.classify_rule(F.col("rule_id"), F.col("rule_groups"))
    projected = (
        base.withColumn("_text", text)
        .withColumns(
            {
                "severity_norm": level / 15.0,
                "_auth": flags.norm_is_auth_failure(F.col("rule_groups"), level),
                "_web": flags.norm_is_web_attack(F.col("rule_groups")),
                "_crit": flags.agent_criticality_max(F.col("agent_name")),
                "_class": c,
                **flags.text_features(F.col("_text")),
                "process_depth": (process_depth if process_depth is not None else F.lit(0)).cast("double"),
            }
        )
        .select(
            *[x for x in dict.fromkeys((*keep, *keys, *order, time, "rule_id", "srcip"))],
            "severity_norm", "mitre_tactic_id", "_auth", "_web", "_crit", "_class.*", "rule_level",
            "touches_sensitive_path", "is_suid_check", "cmdline_priv_tokens", "process_depth",
            F.col("is_auth_failure").alias("_hist_auth"), "kw_scan", "kw_brute",
        )
    )
    item = history_item(
        F.col(time), F.col("rule_level"), F.col("rule_id"), F.col("srcip"),
        F.col("_hist_auth") > 0, F.col("kw_scan") > 0, F.col("kw_brute") > 0,
    )
    seen = agent_history(staged(projected), keys, order, time, item, **kw).withColumns(
        {
            "time_since_last_high": F.when(
                F.col("time_since_last_high") == 0, C.NO_RECENT_HIGH
            ).otherwise(F.col("time_since_last_high")),
            "kill_chain_stage": F.lit(0.0),
            "is_auth_failure": F.col("_auth"),
            "is_web_attack": F.col("_web"),
            "agent_criticality": F.col("_crit"),
        }
    )
    return seen.select(*keep, *C.NORM_FEATURES)


def v2_to_norm(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """PRJ19: map 26-feature rows to 22 columns where the text is no longer at hand.

    Where several signs are set, the later rule of the mapping wins, so each CASE
    tests them from the last to the first.
    """
    on = {c: F.col(c) > 0 for c in C.FEATURES}
    root = on["kw_root"] | on["kw_privilege"]
    category = (
        F.when(on["is_web_attack"], 3.0)
        .when(on["is_auth_failure"], 0.0)
        .when(root, 4.0)
        .when(on["kw_shell"], 1.0)
        .otherwise(5.0)
    )
    kind = (
        F.when(on["kw_shell"], 0.0)
        .when(on["kw_brute"] | on["is_auth_failure"], 2.0)
        .otherwise(5.0)
    )
    result = F.when(on["is_auth_failure"], 1.0).when(on["kw_denied"], 2.0).otherwise(3.0)
    derived = {
        "severity_norm": F.col("rule_level") / 15.0,
        "event_category": category,
        "event_type": kind,
        "event_outcome": result,
        "actor_type": F.when(root, 3.0).otherwise(0.0),
        "touches_sensitive_path": F.lit(0.0),
        "is_suid_check": F.lit(0.0),
        "cmdline_priv_tokens": F.least(
            F.greatest(F.col("kw_root") + F.col("kw_privilege"), F.lit(0.0)), F.lit(5.0)
        ),
        "process_depth": F.lit(0.0),
    }
    return df.select(*keep, *[derived.get(c, F.col(c)).alias(c) for c in C.NORM_FEATURES])
