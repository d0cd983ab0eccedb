"""Data-quality reports: one row per rule, one pass over the data.

``gate`` counts the same rules while the table is written and acts on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from needscope import schemas
from needscope.functions.numbers import count_where
from needscope.sources.scratch import settle


def _report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n_bad, passed) from conditions that are true on bad rows."""
    totals = df.agg(*[count_where(bad).alias(rule) for rule, bad in rules.items()])
    rows = totals.unpivot([], list(rules), "rule", "n_bad")
    return rows.withColumn("passed", F.col("n_bad") == 0)


def _nulls(columns: Sequence[str]) -> dict[str, Column]:
    return {name: F.col(name).isNull() for name in columns}


def _impossible() -> dict[str, Column]:
    severity = F.col("severity")
    broken = (
        (F.col("required_funding_musd") <= 0)
        | (F.col("people_in_need_millions") <= 0)
        | (severity < 1)
        | (severity > 4)
    )
    return {"impossible_rows": broken}


def _contract() -> dict[str, Column]:
    return {
        "people_in_need_positive": F.col("people_in_need_millions") <= 0,
        "required_funding_positive": F.col("required_funding_musd") <= 0,
        "severity_between_1_and_4": ~F.coalesce(F.col("severity").between(1, 4), F.lit(False)),
        "iso3_has_3_characters": F.coalesce(F.length("iso3") != 3, F.lit(True)),
    }


def null_counts(df: DataFrame, columns: Sequence[str] = schemas.NEEDS_CRITICAL) -> DataFrame:
    return _report(df, _nulls(columns))


def impossible_rows(df: DataFrame) -> DataFrame:
    """Rows breaking any logical bound; a null comparison does not count."""
    return _report(df, _impossible())


def required_columns(df: DataFrame, columns: Sequence[str] = schemas.NEEDS_REQUIRED) -> DataFrame:
    """One row per required column and the number of rows lacking it."""
    present = set(df.columns)
    counted = df.agg(
        *[(F.lit(0).cast("bigint") if name in present else F.count(F.lit(1))).alias(name) for name in columns]
    )
    rows = counted.unpivot([], list(columns), "rule", "n_bad")
    found = F.col("rule").isin([name for name in columns if name in present])
    return rows.withColumn("passed", found)


def contract_checks(df: DataFrame) -> DataFrame:
    return _report(df, _contract())


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys seen more than once with their row count.

    The count is combined before the shuffle, so a key that holds a large
    share of the rows still arrives as one row per task.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def _whole(df: DataFrame, columns: Sequence[str]) -> Column:
    """True on rows whose columns all hold a value: neither null nor NaN."""
    kinds = dict(df.dtypes)
    whole = F.lit(True)
    for name in columns:
        whole = whole & F.col(name).isNotNull()
        if kinds[name] in ("double", "float"):
            whole = whole & ~F.isnan(name)
    return whole


def drop_null_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(_whole(df, columns))


def dropped_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows before and after ``drop_null_features``, counted in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), count_where(_whole(df, columns)).alias("n_kept"))
    return counts.withColumn("n_dropped", F.col("n_rows") - F.col("n_kept"))


Action = Literal["report", "set_aside", "fail"]


@dataclass(frozen=True)
class Rule:
    """A condition that is true on bad rows, and what such rows lead to."""

    check: str
    rule: str
    bad: Column
    action: Action = "report"


@dataclass(frozen=True)
class Gated:
    kept: DataFrame
    aside: DataFrame
    report: DataFrame


class QualityError(RuntimeError):
    """Rows broke a rule whose action is ``fail``."""


def needs_rules(df: DataFrame, actions: Mapping[str, Action] | None = None) -> list[Rule]:
    """The rules of the four reports on needs; ``actions`` by name of the report.

    A required column that the table lacks is bad on every row. The other
    reports need their columns, as the functions of their names do.
    """
    present = set(df.columns)
    checks = {
        "null_counts": _nulls(schemas.NEEDS_CRITICAL),
        "impossible_rows": _impossible(),
        "required_columns": {name: F.lit(name not in present) for name in schemas.NEEDS_REQUIRED},
        "contract_checks": _contract(),
    }
    unknown = set(actions or {}) - set(checks)
    if unknown:
        raise ValueError(f"no such reports: {sorted(unknown)}")
    return [
        Rule(check, name, bad, (actions or {}).get(check, "report"))
        for check, rules in checks.items()
        for name, bad in rules.items()
    ]


def _unused(name: str, columns: Sequence[str]) -> str:
    taken = {column.lower() for column in columns}
    while name in taken:
        name += "_"
    return name


def gate(df: DataFrame, rules: Sequence[Rule], name: str = "gated") -> Gated:
    """Write ``df`` once, count its broken rules on the way, and act on them.

    ``report`` has (check, rule, n_bad, passed, action). Rows that break a
    ``set_aside`` rule leave ``kept`` for ``aside``, where ``broken_rules``
    names the rules; a condition that is null counts as kept. A broken
    ``fail`` rule raises QualityError after the write into the scratch folder,
    so before anything behind the gate is touched. Only one count a rule
    reaches the driver. An empty table passes every rule.
    """
    columns = df.columns
    if len({(rule.check, rule.rule) for rule in rules}) < len(rules):
        raise ValueError("two rules have the same check and name")
    flag, broken = _unused("set_aside", columns), _unused("broken_rules", columns)
    hits = [F.when(rule.bad, F.lit(rule.rule)) for rule in rules if rule.action == "set_aside"]
    named = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    counts = [count_where(rule.bad).alias(f"rule_{at}") for at, rule in enumerate(rules)]
    seen = Observation(f"{name}-rules")
    watched = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts)
    marked = watched.withColumn(broken, named).withColumn(flag, F.size(broken) > 0)
    written = settle(marked, name, partition_by=[flag])
    found = seen.get
    rows = [
        (rule.check, rule.rule, found[f"rule_{at}"], found[f"rule_{at}"] == 0, rule.action)
        for at, rule in enumerate(rules)
    ]
    fatal = [f"{check}.{rule}: {n_bad} rows" for check, rule, n_bad, passed, action in rows if action == "fail" and not passed]
    if fatal:
        raise QualityError(f"{name}: " + "; ".join(fatal))
    report = df.sparkSession.createDataFrame(rows, "check string, rule string, n_bad bigint, passed boolean, action string")
    return Gated(
        kept=written.filter(~F.col(flag)).select(*[F.col(f"`{column}`") for column in columns]),
        aside=written.filter(F.col(flag)).drop(flag),
        report=report,
    )
