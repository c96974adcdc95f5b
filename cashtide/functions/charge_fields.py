"""Field-level rules that turn one nested payment charge into flat columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashtide.functions.folds import let

# Currencies quoted without a minor unit.
ZERO_DECIMAL_CURRENCIES = (
    "bif", "clp", "djf", "gnf", "jpy", "kmf", "krw", "mga",
    "pyg", "rwf", "ugx", "vnd", "vuv", "xaf", "xof", "xpf",
)

# Payment status as stored -> as reported.
STATUS_NAMES = {"succeeded": "Paid", "failed": "Failed", "pending": "Pending"}


def reported_status(status: Column) -> Column:
    """Known statuses by name, a missing one as '', any other capitalised."""
    named = F.when(F.coalesce(status, F.lit("")) == "", "")
    for raw, shown in STATUS_NAMES.items():
        named = named.when(status == raw, shown)
    return named.otherwise(
        F.concat(F.upper(F.left(status, F.lit(1))), F.lower(F.substr(status, F.lit(2))))
    )


def major_units(amount: Column, currency: Column) -> Column:
    """Minor units to major units; zero-decimal currencies pass through."""
    whole = F.lower(F.coalesce(currency, F.lit(""))).isin(*ZERO_DECIMAL_CURRENCIES)
    return amount.cast("double") / F.when(whole, 1.0).otherwise(100.0)


def utc_text(epoch_seconds: Column) -> Column:
    """Epoch seconds as 'yyyy-MM-dd HH:mm:ss' in UTC; '' when missing.

    Built on the zone-free timestamp type, so the session time zone cannot change it.
    """
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), epoch_seconds.cast("decimal(18,6)")
    )
    return F.coalesce(moment.cast("string"), F.lit(""))


def tax_on_fee(fee_details: Column) -> Column:
    """Sum of the fee lines of type 'tax', in minor units; NULL when there is none."""
    taxes = F.filter(fee_details, lambda line: line["type"] == "tax")
    total = F.aggregate(
        taxes, F.lit(0).cast("long"), lambda acc, line: acc + F.coalesce(line["amount"], F.lit(0))
    )
    return let(total, lambda t: F.when(t != 0, t))


def first_refund(refunds: Column) -> Column:
    """Earliest refund time in an array of refunds, missing times ignored."""
    return F.array_min(F.transform(refunds, lambda refund: refund["created"]))


def reference_id(reference: Column) -> Column:
    """Id of a reference stored either as a plain id or as a JSON object holding one."""
    is_object = F.ltrim(reference).startswith("{")
    return F.when(is_object, F.get_json_object(reference, "$.id")).otherwise(reference)
