"""Nested payment-API charges to the flat snapshot, and the lower-bounded history pull."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.functions.charge_fields import (
    first_refund,
    major_units,
    reference_id,
    reported_status,
    tax_on_fee,
    utc_text,
)
from cashtide.sources.tables import require_columns

# The fields of a charge that are read.
CHARGE_SCHEMA = """
    id string, created bigint, amount bigint, amount_refunded bigint, currency string,
    status string, captured boolean, description string, failure_message string,
    statement_descriptor string, transfer string,
    balance_transaction struct<fee: bigint, fee_details: array<struct<type: string, amount: bigint>>>,
    refunds struct<data: array<struct<created: bigint>>>,
    outcome struct<seller_message: string>,
    invoice string,
    metadata map<string, string>
"""

# The metadata keys that become columns.
METADATA_KEYS = (
    "OrgName", "OrgCode", "Invoice number", "Site URL", "Order Type",
    "Payment Type", "Product Type", "Product", "Access Plan", "Order ID",
)

# Snapshot columns in contract order. Person-level columns are left out on purpose.
SNAPSHOT_COLUMNS = (
    "id", "Created date (UTC)", "Amount", "Amount Refunded", "Currency", "Captured",
    "Converted Amount", "Converted Amount Refunded", "Converted Currency", "Decline Reason",
    "Description", "Fee", "Refunded date (UTC)", "Statement Descriptor", "Status",
    "Seller Message", "Taxes On Fee", "Invoice ID", "Transfer",
    *(f"{key} (metadata)" for key in METADATA_KEYS),
)

# Snapshot columns that are no text.
SNAPSHOT_TYPES = {
    "Amount": "double", "Amount Refunded": "double", "Captured": "boolean", "Converted Amount": "double",
    "Converted Amount Refunded": "double", "Fee": "double", "Taxes On Fee": "double",
}

# Columns about a person that never leave the source.
PERSON_COLUMNS = ("Customer Email", "Customer Description", "Customer ID", "Card ID")


def parse_charges(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON text to the charge struct. An invoice object stays JSON text inside the string field."""
    return payloads.select(F.from_json(column, CHARGE_SCHEMA).alias("charge")).select("charge.*")


def flatten_charges(charges: DataFrame) -> DataFrame:
    """Nested charges to the fixed snapshot columns, in order."""
    currency = F.col("currency")
    fee_lines = F.col("balance_transaction.fee_details")
    absent_text, absent_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    values: dict[str, Column] = {
        "id": F.col("id"),
        "Created date (UTC)": utc_text(F.col("created")),
        "Amount": major_units(F.col("amount"), currency),
        "Amount Refunded": major_units(F.col("amount_refunded"), currency),
        "Currency": currency,
        "Captured": F.col("captured"),
        # Only the payout reports know the converted amounts.
        "Converted Amount": absent_number,
        "Converted Amount Refunded": absent_number,
        "Converted Currency": absent_text,
        "Decline Reason": F.col("failure_message"),
        "Description": F.col("description"),
        "Fee": major_units(F.col("balance_transaction.fee"), currency),
        "Refunded date (UTC)": utc_text(
            F.nullif(first_refund(F.col("refunds.data")), F.lit(0).cast("long"))
        ),
        "Statement Descriptor": F.col("statement_descriptor"),
        "Status": reported_status(F.col("status")),
        "Seller Message": F.col("outcome.seller_message"),
        "Taxes On Fee": major_units(tax_on_fee(fee_lines), currency),
        "Invoice ID": reference_id(F.col("invoice")),
        "Transfer": F.col("transfer"),
    }
    for key in METADATA_KEYS:
        values[f"{key} (metadata)"] = F.try_element_at("metadata", F.lit(key))
    return charges.select(*[values[name].alias(name) for name in SNAPSHOT_COLUMNS])


# Snapshot column -> name used by the operators.
CHARGE_COLUMNS = {
    "Status": "status",
    "Amount": "amount",
    "Description": "description",
    "Created date (UTC)": "created",
}


def charges_from_snapshot(snapshot: DataFrame, source: str = "snapshot") -> DataFrame:
    """Snapshot or extract columns under the operators' names; the currency is optional."""
    require_columns(snapshot, CHARGE_COLUMNS, source)
    wanted = dict(CHARGE_COLUMNS)
    if "Currency" in snapshot.columns:
        wanted["Currency"] = "currency"
    return snapshot.select(*[F.col(f"`{old}`").alias(new) for old, new in wanted.items()])


def minimise(snapshot: DataFrame) -> DataFrame:
    """Only the contract columns, whatever else an extract carries; missing ones are NULLs of the type that flattened
    charges have there, so both unite."""
    have = set(snapshot.columns)
    return snapshot.select(
        *[
            F.col(f"`{name}`") if name in have else F.lit(None).cast(SNAPSHOT_TYPES.get(name, "string")).alias(name)
            for name in SNAPSHOT_COLUMNS
        ]
    )


def history_since(charges: DataFrame, start: date, created: str = "created") -> DataFrame:
    """Charges created on or after ``start``. The bound is on the raw column and reaches the scan."""
    bound = F.lit(start.isoformat()).cast(charges.schema[created].dataType)
    return charges.filter(F.col(created) >= bound)


def in_feed_order(charges: DataFrame, created: str = "created") -> DataFrame:
    """By (created, id): a total order, so that a re-pull gives the same file. For sinks only."""
    return charges.orderBy(created, "id")
