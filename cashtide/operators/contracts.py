"""Data-quality contracts: named rules, one pass over the data, all failures reported."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``holds`` is the condition a row must meet; NULL counts as not met."""

    name: str
    column: str
    holds: Column

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(False))


class ContractError(ValueError):
    """Raised with every broken rule listed."""


REQUIRED_CHARGE_COLUMNS = ("status", "amount", "description", "created")
EARLIEST_YEAR = 2015

#: What cleaning reads amounts as: NaN, infinite and too large ones are no numbers here.
MONEY = "decimal(18,2)"


def charge_rules(as_of: date, earliest_year: int = EARLIEST_YEAR) -> list[Rule]:
    """Raw-charge contract: status, amount and date present, well-formed and in range.

    A description may be missing. ``as_of`` stands for the present moment; one day is allowed
    beyond it.
    """
    created = F.col("created").try_cast("timestamp_ntz")
    latest = F.lit(as_of.isoformat()).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    in_range = (F.year(created) >= earliest_year) & (created <= latest)
    amount_given = F.col("amount").isNotNull()
    created_given = F.col("created").isNotNull()
    return [
        Rule("status_present", "status", F.col("status").isNotNull()),
        Rule("amount_present", "amount", amount_given),
        Rule(
            "amount_numeric",
            "amount",
            ~amount_given | F.col("amount").try_cast(MONEY).isNotNull(),
        ),
        Rule("created_present", "created", created_given),
        Rule("created_timestamp", "created", ~created_given | created.isNotNull()),
        Rule("created_in_range", "created", created.isNull() | in_range),
    ]


def failure_counts(rules: Sequence[Rule]) -> list[Column]:
    """Aggregates for one pass: rows, and per rule its failures."""
    return [F.count("*").alias("rows"), *[F.count_if(rule.broken).alias(f"n{i}") for i, rule in enumerate(rules)]]


def rule_counts(rules: Sequence[Rule]) -> list[Column]:
    """:func:`failure_counts`, and per rule one offending value."""
    return [
        *failure_counts(rules),
        *[
            F.min(F.when(rule.broken, F.col(rule.column).cast("string"))).alias(f"s{i}")
            for i, rule in enumerate(rules)
        ],
    ]


def quality_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: rows seen, rows that break it, and one offending value.

    A single aggregate over the scan; every rule is a conditional sum with partial aggregation.
    """
    counts = df.agg(*rule_counts(rules))
    lines = [
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.column).alias("column"),
            F.col("rows"),
            F.col(f"n{i}").alias("failures"),
            F.col(f"s{i}").alias("sample"),
        )
        for i, rule in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*lines)))


def enforce(
    df: DataFrame,
    rules: Sequence[Rule],
    required: Sequence[str] = REQUIRED_CHARGE_COLUMNS,
) -> int:
    """Raise with *all* broken rules, or return the number of rows. One row of counts is brought
    to the driver. Extra columns and their order do not matter."""
    require_contract_columns(df, required)
    return judge(df.agg(*rule_counts(rules)).first().asDict(), rules)


def require_contract_columns(
    df: DataFrame, required: Sequence[str] = REQUIRED_CHARGE_COLUMNS
) -> None:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")


def judge(counts: dict, rules: Sequence[Rule]) -> int:
    """The number of rows from a row of :func:`rule_counts`, or an error with all broken rules."""
    broken = [
        f"{rule.name}: {counts[f'n{i}']} rows, e.g. {counts[f's{i}']!r}"
        for i, rule in enumerate(rules)
        if counts[f"n{i}"]
    ]
    if broken:
        raise ContractError("; ".join(broken))
    return counts["rows"]


def with_reasons(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``reasons``: the names of the rules a row breaks, empty for a valid row."""
    names = F.array(*[F.when(rule.broken, rule.name) for rule in rules])
    return df.withColumn("reasons", F.array_compact(names))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reasons)."""
    judged = with_reasons(df, rules)
    return (
        judged.filter(F.size("reasons") == 0).drop("reasons"),
        judged.filter(F.size("reasons") > 0),
    )


def require_rows(df: DataFrame, message: str = "no rows survived cleaning") -> DataFrame:
    """The same DataFrame, or an error when it is empty. Stops at the first row found."""
    if df.isEmpty():
        raise ContractError(message)
    return df


def request_rules(max_horizon: int = 24, levels: Sequence[int] = (80, 95)) -> list[Rule]:
    """Forecast requests: a whole horizon from 1 to ``max_horizon`` and an offered level."""
    return [
        Rule(
            "horizon_in_range",
            "horizon",
            F.col("horizon").between(1, max_horizon) & (F.col("horizon") % 1 == 0),
        ),
        Rule("level_offered", "level", F.col("level").isin(*levels)),
    ]


REQUEST_COLUMNS = ("request_id", "horizon", "level")


def require_known_columns(requests: DataFrame, allowed: Sequence[str] = REQUEST_COLUMNS) -> DataFrame:
    """The same requests, or an error naming the fields the contract does not know."""
    unknown = sorted(set(requests.columns) - set(allowed))
    if unknown:
        raise ContractError(f"unknown request fields: {unknown}")
    return requests


def with_default_level(requests: DataFrame, default: int = 80) -> DataFrame:
    """A request without an interval level gets the default one."""
    return requests.withColumn("level", F.coalesce("level", F.lit(default)))


RESPONSE_COLUMNS = ("request_id", "horizon", "step", "yhat", "lo", "hi")


def forecast_contract(scored: DataFrame) -> DataFrame:
    """Per request: as many rows as months asked for, all finite, none negative, bounds ordered."""
    missing = [name for name in RESPONSE_COLUMNS if name not in scored.columns]
    if missing:
        raise ContractError(f"forecast output lacks columns: {missing}")
    values = [F.col("yhat"), F.col("lo"), F.col("hi")]
    finite = [
        v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) for v in values
    ]
    all_of = lambda conditions: F.bool_and(
        F.coalesce(conditions[0] & conditions[1] & conditions[2], F.lit(False))
    )
    return (
        scored.groupBy("request_id")
        .agg(
            F.max("horizon").alias("horizon"),
            F.count("*").alias("months"),
            all_of(finite).alias("finite"),
            all_of([v >= 0 for v in values]).alias("non_negative"),
            F.bool_and(F.coalesce(F.col("lo") <= F.col("hi"), F.lit(False))).alias("ordered"),
        )
        .withColumn("complete", F.col("months") == F.col("horizon"))
        .withColumn(
            "accepted",
            F.col("complete") & F.col("finite") & F.col("non_negative") & F.col("ordered"),
        )
    )
