"""Projections of one alert: flags, codes, classes and text features."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrylens.functions import constants as C


def as_list(item: Column) -> Column:
    """PRJ1: lift a scalar to a one-element list, null to the empty list."""
    return F.when(item.isNull(), F.array().cast("array<string>")).otherwise(F.array(item))


def text_or_empty(item: Column) -> Column:
    return F.coalesce(item, F.lit(""))


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def literal_map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def contains_any(text: Column, tokens: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(t) for t in tokens])


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    return reduce(or_, [text.startswith(p) for p in prefixes])


def lowered(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), F.lower)


def combined_text(
    description: Column,
    full_log: Column,
    command_line: Column,
    message: Column,
    tactics: Column,
) -> Column:
    """PRJ6: lower-case text of the alert plus the words its tactics stand for."""
    words = literal_map(C.TACTIC_WORDS)
    injected = F.filter(
        F.transform(lowered(tactics), lambda t: F.try_element_at(words, t)), lambda w: w.isNotNull()
    )
    fixed = F.array(*[text_or_empty(c) for c in (description, full_log, command_line, message)])
    return F.lower(F.array_join(F.concat(fixed, injected), " "))


def keyword_flags(text: Column) -> dict[str, Column]:
    """PRJ7: ten substring flags."""
    return {f"kw_{w}": text.contains(w).cast("double") for w in C.KEYWORDS}


def number_or_zero(item: Column) -> Column:
    return F.coalesce(item.try_cast("double"), F.lit(0.0))


def rule_id_code(rule_id: Column) -> Column:
    """PRJ8: the rule number, 0 when it is not an integer."""
    return F.coalesce(F.trim(rule_id).try_cast("bigint").cast("double"), F.lit(0.0))


def is_auth_failure(groups: Column) -> Column:
    """PRJ9."""
    return F.arrays_overlap(lowered(groups), strings(C.AUTH_FAILURE_GROUPS)).cast("double")


def is_web_attack(groups: Column, description: Column) -> Column:
    """PRJ10: by group token, else by a phrase in the description."""
    phrase = contains_any(F.lower(text_or_empty(description)), C.WEB_ATTACK_PHRASES)
    return (F.arrays_overlap(lowered(groups), strings(C.WEB_ATTACK_GROUPS)) | phrase).cast("double")


def tactic_id(tactics: Column) -> Column:
    """PRJ11: number of the first tactic that has one, -1 otherwise."""
    ids = literal_map(C.TACTIC_IDS)
    known = F.filter(
        F.transform(lowered(tactics), lambda t: F.try_element_at(ids, t)), lambda i: i.isNotNull()
    )
    return F.coalesce(F.get(known, 0), F.lit(-1)).cast("double")


def agent_criticality(name: Column) -> Column:
    """PRJ12: weight of the first name part that occurs, else 0."""
    lower = F.lower(text_or_empty(name))
    cases = None
    for part, weight in C.AGENT_CRITICALITY.items():
        hit = lower.contains(part)
        cases = F.when(hit, float(weight)) if cases is None else cases.when(hit, float(weight))
    return cases.otherwise(0.0)


def agent_criticality_max(name: Column) -> Column:
    """PRJ17: the highest weight that occurs, else 1."""
    lower = F.lower(text_or_empty(name))
    best = F.greatest(
        *[F.when(lower.contains(p), float(w)) for p, w in C.AGENT_CRITICALITY.items()]
    )
    return F.coalesce(best, F.lit(1.0))


def kill_chain_stage(tactic: Column) -> Column:
    """PRJ13: stage of a tactic number; unmapped numbers are stage 2."""
    return (
        F.when(tactic.between(0, 2), 0.0)
        .when(tactic == 3, 1.0)
        .when(tactic == 7, 3.0)
        .when(tactic.between(10, 12), 4.0)
        .otherwise(2.0)
    )


def in_group_set(groups_lower: Column, triggers: Iterable[str]) -> Column:
    """Some group contains some trigger as a substring."""
    return F.exists(groups_lower, lambda g: contains_any(g, triggers))


def class_struct(values) -> Column:
    names = ("event_category", "event_type", "event_outcome", "actor_type")
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, values)])


def classify_rule(rule_id: Column, groups: Column) -> Column:
    """PRJ15: semantic class: rule table, else first group set by substring, else default.

    Both tables are fixed and small, so they are literals of the projection.
    """
    table = F.create_map(
        *[x for r, v in C.RULE_CLASSES.items() for x in (F.lit(r), class_struct(v))]
    )
    lower = lowered(groups)
    chain = None
    for triggers, values in C.GROUP_CLASSES:
        hit = in_group_set(lower, triggers)
        chain = (
            F.when(hit, class_struct(values))
            if chain is None
            else chain.when(hit, class_struct(values))
        )
    return F.coalesce(
        F.try_element_at(table, text_or_empty(rule_id)),
        chain.otherwise(class_struct(C.DEFAULT_CLASS)),
    )


def is_mapped(rule_id: Column, groups: Column) -> Column:
    """AGG16: whether the classification came from a rule or group entry."""
    lower = lowered(groups)
    by_group = reduce(
        or_,
        [in_group_set(lower, triggers) for triggers, _ in C.GROUP_CLASSES],
    )
    return text_or_empty(rule_id).isin(*C.RULE_CLASSES) | by_group


def text_features(text: Column) -> dict[str, Column]:
    """PRJ16: sensitive paths, set-uid hunting, privilege words (capped)."""
    return {
        "touches_sensitive_path": text.rlike(C.SENSITIVE_PATH_PATTERN).cast("double"),
        "is_suid_check": text.rlike(C.SUID_PATTERN).cast("double"),
        "cmdline_priv_tokens": F.least(
            F.regexp_count(text, F.lit(C.PRIVILEGE_PATTERN)), F.lit(C.PRIVILEGE_TOKEN_CAP)
        ).cast("double"),
    }


def norm_is_auth_failure(groups: Column, level: Column) -> Column:
    """PRJ17."""
    lower = lowered(groups)
    named = F.arrays_overlap(lower, strings(C.NORM_AUTH_FAILURE_GROUPS))
    login = (level >= 6) & F.arrays_overlap(lower, strings(C.LOGIN_SERVICE_GROUPS))
    return (named | login).cast("double")


def norm_is_web_attack(groups: Column) -> Column:
    """PRJ17."""
    return F.arrays_overlap(lowered(groups), strings(C.NORM_WEB_GROUPS)).cast("double")


def artifact_technique(path: Column) -> Column:
    """PRJ20: technique an artefact path stands for, null for other paths."""
    return F.coalesce(
        F.try_element_at(literal_map(C.ARTIFACT_TECHNIQUE), path),
        F.when(starts_with_any(path, C.USER_DB_PREFIXES), C.USER_DB_TECHNIQUE).when(
            contains_any(path, ("col_", "coluser")), C.UNMAPPED_ARTIFACT
        ),
    )


def names_artifact(path: Column, command: Column, full_log: Column) -> Column:
    """PRJ21: path, command or log names an artefact, or the path maps to a technique."""
    haystack = F.concat_ws(" ", path, command, full_log)
    return contains_any(haystack, C.ARTIFACT_TOKENS) | artifact_technique(path).isNotNull()


def artifact_bucket(path: Column, record_text: Column) -> Column:
    """PRJ22: exact_match, directory_class_only or unrelated."""
    exact = path.isin(*C.ARTIFACT_TECHNIQUE) | contains_any(record_text, C.ARTIFACT_MENTIONS)
    return (
        F.when(exact, "exact_match")
        .when(starts_with_any(path, C.ARTIFACT_DIRECTORIES), "directory_class_only")
        .otherwise("unrelated")
    )


def fim_path_class(path: Column) -> Column:
    """PRJ28: class of a monitored file path; null when there is no path."""
    return (
        F.when(path.isNull(), None)
        .when(path.contains("/cron"), "cron")
        .when(path.contains("/systemd/"), "systemd")
        .when(contains_any(path, ("/profile", ".bashrc", ".profile")), "shell_rc")
        .when(path.contains("/.ssh/"), "ssh_key")
        .when(starts_with_any(path, C.USER_DB_PREFIXES), "account_mgmt")
        .otherwise("other")
    )


def event_flags(rule_id: Column) -> dict[str, Column]:
    """PRJ30: stage flags from the rule number."""
    return {
        "is_web_scan": rule_id.isin("31101", "31151", "31104", "31516"),
        "is_auth_fail": rule_id.isin("5710", "5712", "5503", "60122", "60204"),
        "is_auth_success": rule_id.isin("5501", "60106"),
        "is_account_mgmt": rule_id.isin("5901", "5902", "5903"),
    }


def align(features: Iterable[str], weights) -> dict[str, Column]:
    """PRJ29: X @ W as one dot product per output column."""
    names = list(features)
    return {
        f"aligned_{j}": reduce(
            lambda a, b: a + b, [F.col(n) * float(weights[i][j]) for i, n in enumerate(names)]
        )
        for j in range(len(weights[0]))
    }
