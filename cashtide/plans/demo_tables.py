"""Charges, nested charges, requests and drift samples derived from the star-schema test tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.operators.cleaning import clean_charges
from cashtide.settings import Settings
from cashtide.sources.tables import read_parquet

DEMO = Settings(
    as_of=date(2001, 8, 15), series_start=date(1995, 1, 1), disruption_end=date(1996, 4, 1)
)

SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def _pick(key: Column, mapping: dict, otherwise=None) -> Column:
    picked = F.lit(otherwise)
    for value, result in reversed(mapping.items()):
        picked = F.when(key == value, F.lit(result)).otherwise(picked)
    return picked


def order_currency() -> Column:
    slot = F.col("o_custkey") % 20
    return F.when(slot == 0, "usd").when(slot == 1, F.lit(None)).when(slot == 2, "AUD").otherwise("aud")


def order_description() -> Column:
    return _pick(
        F.col("o_orderpriority"),
        {
            "1-URGENT": "iv league - Booking",
            "2-HIGH": " Subscription update ",
            "3-MEDIUM": "Subscription creation",
            "5-LOW": "Package initiation",
        },
    )


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per payment charge. ``payer`` leads to the customer's segment and nation."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("payer"),
        F.col("o_orderdate").alias("created"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        _pick(F.col("o_orderstatus"), {"F": "Paid", "O": "Pending", "P": "Failed"}).alias("status"),
        order_currency().alias("currency"),
        order_description().alias("description"),
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_charges(charges(spark, sf_dir), DEMO, keep=("id", "payer"))


def payer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payer -> '<segment>|<nation>', the many-series key."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("payer"),
            F.concat_ws("|", "c_mktsegment", "n_name").alias("series_id"),
        )
    )


def charge_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as nested payment-API charges in JSON text, one per row."""
    key, payer, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    epoch = F.unix_date(day.cast("date")).cast("long") * 86400
    minor = F.round(F.col("o_totalprice") * 100).cast("long")
    refunds = F.when(
        key % 11 == 0,
        F.array(
            F.struct((epoch + 172800).alias("created")),
            F.struct((epoch + 86400).alias("created")),
            F.struct(F.lit(None).cast("long").alias("created")),
        ),
    ).otherwise(F.array().cast("array<struct<created:bigint>>"))
    invoice_id = F.concat(F.lit("in_"), key.cast("string"))
    fields = [
        key.cast("string").alias("id"),
        epoch.alias("created"),
        minor.alias("amount"),
        F.when(key % 11 == 0, minor).otherwise(0).alias("amount_refunded"),
        F.when(payer % 20 == 3, "jpy").otherwise(order_currency()).alias("currency"),
        _pick(
            F.col("o_orderstatus"), {"F": "succeeded", "O": "pending"}, "disputed"
        ).alias("status"),
        (key % 7 != 0).alias("captured"),
        order_description().alias("description"),
        F.struct(
            (key % 1000).alias("fee"),
            F.array(
                F.struct(F.lit("tax").alias("type"), (key % 5).alias("amount")),
                F.struct(F.lit("processing").alias("type"), (key % 1000).alias("amount")),
                F.struct(F.lit("tax").alias("type"), (key % 3).alias("amount")),
            ).alias("fee_details"),
        ).alias("balance_transaction"),
        F.struct(refunds.alias("data")).alias("refunds"),
        F.struct(F.when(key % 4 == 0, "Payment complete.").alias("seller_message")).alias("outcome"),
        F.create_map(
            F.lit("OrgName"),
            F.concat(F.lit("org-"), (payer % 50).cast("string")),
            F.lit("Order ID"),
            key.cast("string"),
            F.lit("unlisted"),
            F.lit("x"),
        ).alias("metadata"),
        F.concat(F.lit("person-"), payer.cast("string")).alias("customer"),
    ]
    # Even keys carry the invoice as an id, odd keys as an object.
    as_id = F.to_json(F.struct(*fields, invoice_id.alias("invoice")))
    as_object = F.to_json(F.struct(*fields, F.struct(invoice_id.alias("id")).alias("invoice")))
    return table(spark, sf_dir, "orders").select(
        F.when(key % 2 == 0, as_id).otherwise(as_object).alias("payload")
    )


def raw_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges as text, the way an extract arrives, with every kind of defect in it."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(key % 113 == 0, F.lit(None))
        .otherwise(_pick(F.col("o_orderstatus"), {"F": "Paid", "O": "Pending", "P": "Failed"}))
        .alias("status"),
        F.when(key % 97 == 0, "n/a")
        .when(key % 101 == 0, F.lit(None))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .alias("amount"),
        order_description().alias("description"),
        F.when(key % 103 == 0, "not a date")
        .when(key % 107 == 0, "2099-01-01 00:00:00")
        .when(key % 109 == 0, F.lit(None))
        .otherwise(F.col("o_orderdate").cast("string"))
        .alias("created"),
    )


def person_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extract that also carries columns about persons."""
    payer = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderdate").cast("string").alias("Created date (UTC)"),
        F.col("o_totalprice").alias("Amount"),
        order_currency().alias("Currency"),
        order_description().alias("Description"),
        F.concat(F.lit("p"), payer, F.lit("@example.org")).alias("Customer Email"),
        payer.alias("Customer ID"),
        F.concat(F.lit("card-"), payer).alias("Card ID"),
        F.lit("note").alias("Customer Description"),
    )


def forecast_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving requests, some of them invalid (horizon 0 or 25, level 90) or without a level."""
    slot = F.col("o_custkey") % 4
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_orderkey") % 26).cast("int").alias("horizon"),
        F.when(slot == 0, 80).when(slot == 1, 95).when(slot == 2, 90).alias("level"),
        F.col("o_orderdate").alias("asked_at"),
    )


def drift_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events split into a reference and a current period at mid-month."""
    return table(spark, sf_dir, "events").select(
        F.when(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), "reference")
        .otherwise("current")
        .alias("period"),
        "event_type",
        F.get_json_object("props", "$.k").alias("k"),
        "value",
        "user_id",
    )


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model-registry listing: one row per registered version."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model"),
        F.col("p_partkey").cast("int").alias("version"),
        F.when(F.col("p_size") % 3 == 0, "intervals-v1").alias("contract"),
        F.when(F.col("p_size") == 50, "champion").alias("alias"),
        F.col("p_name").alias("run_id"),
    )
