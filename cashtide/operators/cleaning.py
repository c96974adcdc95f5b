"""Paid, domestic, dated and categorised charges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashtide.functions.categories import DEFAULT_RULES, StreamRule, stream_of
from cashtide.functions.clock import utc_wall_clock
from cashtide.operators.contracts import MONEY
from cashtide.settings import Settings


def is_domestic(currency: Column, home: str) -> Column:
    """Charges in the home currency, in any case; an unstated currency counts as domestic."""
    return F.lower(F.coalesce(currency, F.lit(home))) == home


def amount_or_zero(amount: Column) -> Column:
    """Money as an exact decimal; what cannot be read as a number counts as 0."""
    return F.coalesce(amount.try_cast(MONEY), F.lit(0).cast(MONEY))


def naive_utc(df: DataFrame, column: str) -> Column:
    """The column as a zone-free UTC timestamp; refuses a column that is not a timestamp."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.col(column)
    if isinstance(kind, T.TimestampType):
        return utc_wall_clock(F.col(column))
    raise ValueError(f"{column!r} did not parse as a timestamp (it is {kind.simpleString()})")


def is_kept(columns: Sequence[str], settings: Settings) -> Column:
    """Whether :func:`clean_charges` keeps a charge; never NULL. For plans that also count the others."""
    kept = F.coalesce(F.col("status") == "Paid", F.lit(False))
    return kept & is_domestic(F.col("currency"), settings.home_currency) if "currency" in columns else kept


def clean_charges(
    charges: DataFrame,
    settings: Settings,
    rules: tuple[StreamRule, ...] = DEFAULT_RULES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``charges(created, amount, status, description[, currency])`` -> one row per kept charge:
    ``created, amount, category, description`` plus the ``keep`` columns."""
    kept = charges.filter(F.col("status") == "Paid")  # plain, so that it reaches the scan
    if "currency" in charges.columns:
        kept = kept.filter(is_domestic(F.col("currency"), settings.home_currency))
    return kept.select(
        *keep,
        naive_utc(charges, "created").alias("created"),
        amount_or_zero(F.col("amount")).alias("amount"),
        stream_of(F.col("description"), rules).alias("category"),
        "description",
    )


def dropped_currency_audit(charges: DataFrame, settings: Settings) -> DataFrame:
    """What the domestic guard leaves out: rows and money per foreign currency."""
    return (
        charges.filter(~is_domestic(F.col("currency"), settings.home_currency))
        .groupBy(F.lower("currency").alias("currency"))
        .agg(F.count("*").alias("dropped_rows"), F.sum("amount").alias("dropped_amount"))
    )
