"""The rule table: one row per rule, ready for matching.

``builtin_rules`` gives the shipped packs; ``check_rules`` turns rules a user
wrote (two notations) into the same rows and says which ones were refused.
"""
from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import required_words, to_finder, to_java
from ..functions.severity import SEVERITY_RANK
from . import language_packs as lp
from . import web_packs as wp
from .pattern_pack import PATTERN_RULES
from .weaknesses import WEAKNESSES

RULE_SCHEMA = """
rule_id string, pack string, name string, language string, severity string, sev_rank int, cwe string,
category string, message string, remediation string, auto_fixable boolean, fix_template string, scope string,
patterns array<struct<source:string,finder:string,words:array<array<string>>>>, once boolean, must array<string>,
guard string, mask string, context int, cves array<string>, implemented boolean, enabled boolean, is_custom boolean
"""
RULE_COLUMNS = ["rule_id", "pack", "name", "language", "severity", "sev_rank", "cwe", "category", "message",
                "remediation", "auto_fixable", "fix_template", "scope", "patterns", "once", "must", "guard", "mask",
                "context", "cves", "implemented", "enabled", "is_custom"]

ANY_LANGUAGE = "any"
LINE, FILE, FACT = "line", "file", "fact"

# How much of the text around a match goes in the snippet.
MATCH_ONLY, OWN_LINE = -1, 0


def wildcard_regex(pattern: str, literal_ellipsis: bool = True) -> str:
    """A pattern written as code, as a Python regular expression."""
    regex = re.escape(pattern)
    if "$X" in pattern or "$Y" in pattern:
        for name in (r"\$X", r"\$Y"):
            regex = regex.replace(name, r"([^\s()]+)")
    if not literal_ellipsis:
        regex = regex.replace(r"\.\.\.", r".*?").replace(r"\$Z", r"([^\s()]+)")
    return regex


def _pattern(source: str, regex: str, **flags) -> tuple:
    return (source, to_finder(regex, **flags), required_words(regex))


def rule_row(rule_id, pack, name, language, severity, cwe, *, scope, patterns=(), once=False, must=(),
             guard=None, mask="", context=MATCH_ONLY, fix_template=None, auto_fixable=False, cves=(),
             implemented=True, is_custom=False, message=None, remediation=None, category=None) -> tuple:
    number = int(re.sub(r"\D", "", str(cwe)) or 0)
    kind, wrong, cure = WEAKNESSES.get(number, ("other", "a risky construct is used", "Review this code."))
    return (
        rule_id, pack, name, language, severity, SEVERITY_RANK.get(severity, 0), f"CWE-{number}" if number else None,
        category or kind, message or f"{name}: {wrong}", remediation or cure, auto_fixable, fix_template, scope,
        [tuple(p) for p in patterns], once, list(must), guard, mask, context, list(cves), implemented, True, is_custom,
    )


def _title(rule_id: str) -> str:
    return re.sub(r"^(generic-|go-|js-|py-|java-|ruby-|php-|JS-)", "", rule_id).replace("_", "-").lower()


def _any_of(regexes: list[str]) -> str:
    return to_java("(?i)" + "|".join(regexes))


def _pattern_pack(literal_ellipsis: bool) -> list[tuple]:
    return [
        rule_row(rule_id, "pattern", _title(rule_id), language, severity, cwe, scope=LINE,
                 patterns=[_pattern(p, wildcard_regex(p, literal_ellipsis), by_line=True) for p in patterns],
                 fix_template=fix, auto_fixable=fix is not None)
        for rule_id, language, severity, cwe, fix, patterns in PATTERN_RULES
    ]


def _python_pack() -> list[tuple]:
    guard = _any_of(lp.PYTHON_NO_SECRET)
    rows = []
    for rule_id, name, severity, cwe, how, cves in lp.PYTHON_RULES:
        line = lp.PYTHON_LINES.get(rule_id)
        regex, must, guarded = line or (None, (), False)
        rows.append(rule_row(
            rule_id, "python", name, "python", severity, cwe, scope=LINE if line else FACT, once=True, context=1,
            patterns=[_pattern(regex, regex, by_line=True)] if line else [],
            must=[to_java(m, by_line=True) for m in must], guard=guard if guarded else None,
            mask="quoted" if cwe == 798 else "", cves=cves, implemented=bool(how)))
    return rows


def _rust_pack() -> list[tuple]:
    guard = _any_of(lp.RUST_NO_SECRET)
    rows = []
    for rule_id, name, severity, cwe, how in lp.RUST_RULES:
        line = lp.RUST_LINES.get(rule_id)
        regex, ignore_case, guarded = line or (None, False, False)
        rows.append(rule_row(
            rule_id, "rust", name, "rust", severity, cwe, scope=LINE if line else FACT, once=True, context=1,
            patterns=[_pattern(regex, regex, ignore_case=ignore_case, by_line=True)] if line else [],
            guard=guard if guarded else None, mask="quoted" if cwe == 798 else "", implemented=bool(how)))
    return rows


def _go_pack() -> list[tuple]:
    rows = [
        rule_row(rule_id, "go", _title(rule_id), "go", severity, cwe, scope=FILE, context=OWN_LINE,
                 patterns=[_pattern(regex, regex, ignore_case=True, multiline=True)])
        for rule_id, severity, cwe, regex in lp.GO_RULES
    ]
    rows += [
        rule_row(rule_id, "go", _title(rule_id), "go", severity, 798, scope=FILE, context=OWN_LINE, mask=mask,
                 patterns=[_pattern(regex, regex, ignore_case=True)])
        for rule_id, severity, regex, mask in lp.GO_SECRETS
    ]
    for rule_id, cwe in (("go-defer-in-loop", 772), ("go-unsafe-pointer-ast", 466)):
        rows.append(rule_row(rule_id, "go", _title(rule_id), "go", "medium", cwe, scope=FACT, context=OWN_LINE))
    return rows


def _javascript_pack() -> list[tuple]:
    rows = [
        rule_row(rule_id, "javascript", _title(rule_id), "javascript", severity, cwe, scope=LINE, context=3,
                 patterns=[_pattern(regex, regex, ignore_case=True, by_line=True)], auto_fixable=fixable)
        for rule_id, severity, cwe, regex, fixable in wp.JAVASCRIPT_LINES
    ]
    rows.append(rule_row(
        "JS-REGEX-001", "javascript", "slow-regex", "javascript", "medium", 400, scope=LINE, context=3, once=True,
        patterns=[_pattern(wp.REGEX_LITERAL, wp.REGEX_LITERAL, by_line=True)],
        must=[to_java("|".join(wp.NESTED_QUANTIFIERS), by_line=True)]))
    rows.append(rule_row(
        "JS-HARDCODED-SECRET", "javascript", "hardcoded-secret", "javascript", "high", 798, scope=FILE,
        context=OWN_LINE, mask="quoted", auto_fixable=True,
        patterns=[_pattern(p, p, ignore_case=True) for p in wp.JAVASCRIPT_SECRETS]))
    rows += [rule_row(rule_id, "javascript", _title(rule_id), "javascript", severity, cwe, scope=FACT, context=3)
             for rule_id, severity, cwe in wp.JAVASCRIPT_FACTS]
    return rows


def _generic_pack() -> list[tuple]:
    return [
        rule_row(rule_id, "generic", _title(rule_id), ANY_LANGUAGE, severity, cwe, scope=FILE, context=OWN_LINE,
                 patterns=[_pattern(regex, regex, ignore_case=True)], mask=mask, auto_fixable=fixable)
        for rule_id, severity, cwe, regex, mask, fixable in wp.GENERIC
    ]


PACKS = ("pattern", "python", "rust", "go", "javascript", "generic")


@lru_cache(maxsize=4)
def builtin_rules(literal_ellipsis: bool = True) -> tuple:
    """All shipped rules as rows of RULE_SCHEMA."""
    return tuple(_pattern_pack(literal_ellipsis) + _python_pack() + _rust_pack() + _go_pack()
                 + _javascript_pack() + _generic_pack())


def rules_frame(spark: SparkSession, rows=None, packs=None) -> DataFrame:
    rows = builtin_rules() if rows is None else rows
    if packs is not None:
        rows = [r for r in rows if r[1] in packs]
    return spark.createDataFrame(list(rows), RULE_SCHEMA)


# --- rules written by users --------------------------------------------------

REQUIRED = ("id", "name", "language", "severity", "patterns")
ERROR_SCHEMA = "rule_id string, problem string"


def check_rules(written: list[dict]) -> tuple[list[tuple], list[tuple]]:
    """Rows for the rules that can be used, and (rule_id, problem) for the rest.

    Takes ``language`` or a list ``languages``, ``cwe`` or ``cwe_id``, one
    pattern or a list.  ``pattern_kind`` says whether patterns are code with
    wildcards (``literal``) or regular expressions (``regex``, the way of rules
    with ``languages``).
    """
    rows, errors = [], []
    for rule in written:
        rule_id = rule.get("id")
        languages = rule.get("languages") or ([rule["language"]] if rule.get("language") else [])
        shown = {**rule, "language": languages or None}
        missing = [field for field in REQUIRED if not shown.get(field)]
        if missing:
            errors.append((rule_id, "missing " + ", ".join(missing)))
            continue
        severity = str(rule["severity"]).lower()
        if severity not in SEVERITY_RANK:
            errors.append((rule_id, f"unknown severity {severity}, medium used"))
            severity = "medium"
        kind = rule.get("pattern_kind") or ("regex" if "languages" in rule else "literal")
        sources = rule["patterns"] if isinstance(rule["patterns"], list) else [rule["patterns"]]
        patterns = []
        for source in sources:
            regex = source if kind == "regex" else wildcard_regex(source, rule.get("literal_ellipsis", True))
            try:
                re.compile(regex)
                patterns.append(_pattern(source, regex, by_line=True))
            except (re.error, ValueError) as problem:
                errors.append((rule_id, f"pattern refused: {problem}"))
        for language in languages:
            rows.append(rule_row(
                rule_id, "custom", rule["name"], language, severity, rule.get("cwe") or rule.get("cwe_id") or "",
                scope=LINE, patterns=patterns, fix_template=rule.get("fix_template"),
                auto_fixable=bool(rule.get("auto_fixable", False)), is_custom=True,
                message=rule.get("description"), remediation=rule.get("remediation"), category=rule.get("category")))
    return rows, errors


def upsert_rules(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """Take ``updates`` over ``rules`` by rule, pack and language; new ones are added.

    A null in an update keeps the old value.
    """
    keys = ["rule_id", "pack", "language"]
    columns: list[Column] = [F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in rules.columns]
    same = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    return rules.alias("old").join(updates.alias("new"), same, "full").select(*columns)


def enable_rules(rules: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Switch on just the named rules; ``["*"]`` means all."""
    if "*" in rule_ids:
        return rules.withColumn("enabled", F.lit(True))
    return rules.withColumn("enabled", F.col("rule_id").isin(rule_ids))


def list_rules(rules: DataFrame, category: str | None = None) -> DataFrame:
    """The rules, or those of a category."""
    chosen = rules if category is None else rules.where(F.lower("category") == category.lower())
    return chosen.select(
        F.col("rule_id"), F.coalesce("name", F.col("rule_id")).alias("name"),
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.coalesce("language", F.lit("any")).alias("language"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("cwe", F.lit("N/A")).alias("cwe"), "category")
