"""Rules: conjunctions of feature == 0 or 1, their text form, provenance and counts.

In Python a rule is a list of (feature, value); in a table it is
array<struct<feature:string,value:int>> in sorted order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from .stats import condition_counts, with_metrics

Rule = list[tuple[str, int]]
RULE_TYPE = "array<struct<feature:string,value:int>>"

_CONDITION = re.compile(r"\(\s*'((?:[^'\\]|\\.)*)'\s*==\s*([01])\s*\)")
_TREE_PART = re.compile(r"\s*(.+?)\s*(<=|>=|<|>)\s*(-?\d+(?:\.\d+)?)\s*")
_GROUP_PART = re.compile(r"\s*\(?\s*(.+?)\s*==\s*(True|False|1|0)\s*\)?\s*")


def validate_parsed_rules(rules: Iterable[Rule]) -> list[Rule]:
    """The rules, if each is a list of (text, 0 or 1); TypeError or ValueError else."""
    out = []
    for rule in rules:
        if not isinstance(rule, (list, tuple)):
            raise TypeError(f"a rule must be a list, not {type(rule).__name__}")
        for part in rule:
            if not isinstance(part, (list, tuple)) or len(part) != 2:
                raise ValueError(f"a condition must be a pair, not {part!r}")
            feature, value = part
            if not isinstance(feature, str) or isinstance(value, bool) or not isinstance(value, int):
                raise TypeError(f"a condition must be (text, integer), not {part!r}")
            if value not in (0, 1):
                raise ValueError(f"a condition's value must be 0 or 1, not {value}")
        out.append([tuple(p) for p in rule])
    return out


def normalize_rule(rule: Rule) -> Rule:
    """Conditions in order, each once."""
    return sorted({(f, int(v)) for f, v in rule})


def normalized(rule: Column) -> Column:
    return F.array_sort(F.array_distinct(rule))


def rule_text(rule: Rule) -> str:
    escaped = lambda f: f.replace("\\", "\\\\").replace("'", "\\'")
    return " AND ".join(f"('{escaped(f)}' == {v})" for f, v in rule)


def parse_rule_text(text: str) -> Rule:
    """The inverse of :func:`rule_text`; also ``feature == 1`` alone.  Malformed text raises ValueError."""
    found, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _CONDITION.match(text, at)
        if not m:
            single = re.fullmatch(r"(.+?)\s*==\s*([01])", text)
            if single and not found:
                return [(single[1].strip().strip("'"), int(single[2]))]
            raise ValueError(f"malformed rule: {text!r}")
        found.append((re.sub(r"\\(.)", r"\1", m[1]), int(m[2])))
        at = m.end()
        if at < len(text):
            if not text.startswith(" AND ", at):
                raise ValueError(f"malformed rule: {text!r}")
            at += 5
    if not found:
        raise ValueError("empty rule")
    return found


def parse_rule_string_to_tuples(rule_str: str) -> Rule:
    """``f > 0.5 and g <= 0.5`` to conditions; only the word between conditions separates them."""
    out = []
    for part in re.split(r"\s+and\s+(?=\S+.*?(?:<=|>=|<|>))", rule_str.strip()):
        m = _TREE_PART.fullmatch(part)
        if not m:
            raise ValueError(f"malformed condition: {part!r}")
        out.append((m[1], 1 if m[2] in (">", ">=") else 0))
    return out


def parse_rulefit_rules(rules: Iterable[str]) -> list[Rule]:
    out = []
    for i, text in enumerate(rules):
        if not isinstance(text, str):
            raise TypeError(f"rule {i} is not text")
        out.append(parse_rule_string_to_tuples(text))
    return out


def parse_subgroup_rule_to_tuples(rule_str: str, target_prefix: str = "target_") -> Rule:
    """``(f==True AND g==False)`` to conditions; those on the target are left out."""
    text = rule_str.strip()
    if text.startswith("(") and text.endswith(")"):
        text = text[1:-1]
    out = []
    for part in re.split(r"\s+AND\s+", text):
        m = _GROUP_PART.fullmatch(part)
        if not m:
            raise ValueError(f"malformed condition: {part!r}")
        if not m[1].startswith(target_prefix):
            out.append((m[1].strip("'"), 1 if m[2] in ("True", "1") else 0))
    return out


def parse_subgroup_rules(rules: Iterable[str], target_prefix: str = "target_") -> list[Rule]:
    return [parse_subgroup_rule_to_tuples(r, target_prefix) for r in rules]


def parse_apriori_rules(antecedents: Iterable[Iterable[str]]) -> list[Rule]:
    """Item sets to rules that ask for each item."""
    return [sorted((str(i), 1) for i in items) for items in antecedents]


def compute_rule_depth(text: str) -> int:
    """Conditions of a rule in text form; blank text has none."""
    if not text or not text.strip():
        return 0
    try:
        return len(parse_rule_text(text))
    except ValueError:
        return text.count(" AND ") + 1


def rules_table(spark: SparkSession, rule_sources: Iterable[tuple[Rule, str]]) -> DataFrame:
    """rule, source."""
    rows = [([{"feature": f, "value": v} for f, v in rule], source) for rule, source in rule_sources]
    return spark.createDataFrame(rows, f"rule {RULE_TYPE}, source string")


def deduplicate_rules_with_provenance(rules: DataFrame) -> DataFrame:
    """rule, sources: each rule once with the miners that found it."""
    return rules.groupBy(normalized(F.col("rule")).alias("rule")).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def count_rules_per_algorithm(deduplicated: DataFrame) -> DataFrame:
    """source, n_rules."""
    return deduplicated.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n_rules"))


def normalize_and_dedup_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    unique = deduplicate_rules_with_provenance(rules)
    return unique, count_rules_per_algorithm(unique)


def condition(df: DataFrame, rule: Rule) -> Column:
    """Whether a row meets a rule; an unknown feature raises KeyError, a null meets none."""
    parts = []
    for feature, value in rule:
        if feature not in df.columns:
            raise KeyError(feature)
        parts.append(F.coalesce(quoted(feature).cast("int") == value, F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def generate_rule_activation_dataframe(df: DataFrame, unique_rules: Sequence[Rule], target_col: str, prefix: str = "rule") -> tuple[DataFrame, dict[str, str]]:
    """One boolean column for each rule and the target, and the rules' texts by column."""
    names = {f"{prefix}_{i:04d}": rule for i, rule in enumerate(unique_rules)}
    out = df.select(*[condition(df, r).alias(n) for n, r in names.items()], quoted(target_col))
    return out, {n: rule_text(r) for n, r in names.items()}


def rule_stats(df: DataFrame, rules: Sequence[Rule], target_col: str, stat_registry=None) -> DataFrame:
    """Metrics and depth of each rule and class, without widening the table."""
    conditions = {rule_text(r): condition(df, r) for r in rules}
    depths = {rule_text(r): len(r) for r in rules}
    table = with_metrics(condition_counts(df, conditions, target_col), stat_registry)
    if not depths:
        return table.withColumn("rule_depth", F.lit(0))
    depth = df.sparkSession.createDataFrame(list(depths.items()), "antecedents string, rule_depth int")
    return table.join(depth, "antecedents").select(*table.columns, "rule_depth")


def merge_multivar_map_into_stats(multivar_stats: DataFrame, multivar_map: dict[str, str], antecedents_col: str = "antecedents") -> DataFrame:
    """Adds ``human_readable_rule`` of each rule column."""
    texts = multivar_stats.sparkSession.createDataFrame(list(multivar_map.items()) or [("", "")], "rule_column string, human_readable_rule string")
    key = F.regexp_replace(quoted(antecedents_col), r"\s*==\s*1$", "")
    return multivar_stats.join(texts, key == F.col("rule_column"), "left")
