from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from conftest import CHARGE_DDL
from pyspark.sql import functions as F

from cashtide.functions.categories import StreamRule, stream_of
from cashtide.functions.charge_fields import major_units, reported_status, utc_text
from cashtide.operators import monthly
from cashtide.operators.cleaning import clean_charges, dropped_currency_audit, naive_utc
from cashtide.operators.profiles import by_total, category_summary
from cashtide.sources import charge_feed


@pytest.mark.parametrize(
    "text, stream",
    [
        ("Subscription creation", "recurring"),
        ("Subscription update", "recurring"),
        ("  Subscription update\t", "recurring"),
        ("subscription update", "one_time"),
        ("IV League - Booking", "league"),
        ("a booking, iv league", "league"),
        ("Package initiation", "one_time"),
        ("", "one_time"),
        ("   ", "one_time"),
        (None, "one_time"),
    ],
)
def test_stream_of(spark, text, stream):
    row = spark.createDataFrame([(text,)], "d string").select(stream_of(F.col("d")).alias("s"))
    assert row.first()["s"] == stream


def test_rules_are_ordered(spark):
    rules = (StreamRule("first", pattern="x"), StreamRule("second", exact=("xy",)))
    got = spark.createDataFrame([("xy",)], "d string").select(stream_of(F.col("d"), rules)).first()[0]
    assert got == "first"


def test_cleaning_keeps_three_rows(charges, settings):
    kept = clean_charges(charges, settings)
    assert kept.columns == ["created", "amount", "category", "description"]
    assert [r["category"] for r in kept.orderBy("created").collect()] == [
        "recurring",
        "recurring",
        "one_time",
    ]


def test_unstated_currency_is_kept_and_case_ignored(spark, settings):
    rows = [
        ("Paid", datetime(2021, 1, 1), 1.0, c, "x") for c in (None, "AUD", "aud", "Usd", "nzd")
    ]
    frame = spark.createDataFrame(rows, CHARGE_DDL)
    assert clean_charges(frame, settings).count() == 3
    dropped = {r["currency"]: r["dropped_rows"] for r in dropped_currency_audit(frame, settings).collect()}
    assert dropped == {"usd": 1, "nzd": 1}


def test_unreadable_amount_counts_as_zero(spark, settings):
    frame = spark.createDataFrame(
        [("Paid", datetime(2021, 1, 1), "oops", "x")],
        "status string, created timestamp_ntz, amount string, description string",
    )
    assert float(clean_charges(frame, settings).first()["amount"]) == 0.0


def test_created_must_be_a_timestamp(spark, settings):
    frame = spark.createDataFrame(
        [("Paid", "2021-01-01", 1.0, "x")],
        "status string, created string, amount double, description string",
    )
    with pytest.raises(ValueError, match="did not parse"):
        clean_charges(frame, settings)


def test_zoned_timestamps_become_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        frame = spark.range(1).select(F.timestamp_seconds(F.lit(1609459200)).alias("t"))
        assert frame.select(naive_utc(frame, "t").cast("string")).first()[0] == "2021-01-01 00:00:00"
        text = spark.range(1).select(utc_text(F.lit(1609459200))).first()[0]
        assert text == "2021-01-01 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_monthly_series_is_filled_and_totals_add_up(charges, settings):
    cleaned = clean_charges(charges, settings)
    sums = monthly.monthly_sums(cleaned, settings)
    long = monthly.fill_calendar(sums, settings, streams=settings.streams)
    wide = monthly.add_features(monthly.widen(long, settings.streams), settings)
    rows = wide.orderBy("month").collect()
    assert [r["month"] for r in rows] == [date(2020, 12, 1), date(2021, 1, 1), date(2021, 2, 1), date(2021, 3, 1)]
    assert [r["recurring"] for r in rows] == [0.0, 349.0, 599.0, 0.0]
    assert all(r["league"] == 0.0 for r in rows)
    assert all(r["total"] == r["league"] + r["recurring"] + r["one_time"] for r in rows)
    assert all(r["disrupted"] == 1 for r in rows)
    undone = wide.select(F.max(F.abs(monthly.undo_log(F.col("recurring_log")) - F.col("recurring"))))
    assert undone.first()[0] < 1e-6


def test_calendar_stops_at_the_data_and_at_the_last_complete_month(spark, settings, charges):
    cleaned = clean_charges(charges, settings)
    sums = monthly.monthly_sums(cleaned, settings)
    # as_of 2021-04-10: March is complete and is the last month with data.
    assert monthly.fill_calendar(sums, settings).agg(F.max("month")).first()[0] == date(2021, 3, 1)
    early = type(settings)(as_of=date(2021, 3, 20), series_start=settings.series_start)
    assert monthly.fill_calendar(sums, early).agg(F.max("month")).first()[0] == date(2021, 2, 1)
    late = type(settings)(as_of=date(2022, 1, 1), series_start=settings.series_start)
    assert monthly.fill_calendar(sums, late).agg(F.max("month")).first()[0] == date(2021, 3, 1)


def test_long_and_wide_are_inverse(charges, settings):
    sums = monthly.monthly_sums(clean_charges(charges, settings), settings)
    long = monthly.fill_calendar(sums, settings, streams=settings.streams).select(
        "month", "series_id", "y"
    )
    back = monthly.unpivot_streams(monthly.widen(long, settings.streams), settings.streams)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_category_summary_shares_come_from_rounded_totals(charges, settings):
    rows = {r["category"]: r for r in category_summary(clean_charges(charges, settings)).collect()}
    ordered = by_total(category_summary(clean_charges(charges, settings))).collect()
    assert [r["category"] for r in ordered] == ["one_time", "recurring"]
    assert rows["recurring"]["transactions"] == 2
    assert rows["recurring"]["total"] == 948.0
    assert rows["one_time"]["share_pct"] == 69.9


@pytest.mark.parametrize(
    "raw, shown",
    [("succeeded", "Paid"), ("failed", "Failed"), ("pending", "Pending"), (None, ""), ("", ""),
     ("uNDER review", "Under review")],
)
def test_reported_status(spark, raw, shown):
    got = spark.createDataFrame([(raw,)], "s string").select(reported_status(F.col("s"))).first()[0]
    assert got == shown


@pytest.mark.parametrize(
    "amount, currency, major",
    [(1234, "aud", 12.34), (1234, "JPY", 1234.0), (1234, None, 12.34), (None, "aud", None)],
)
def test_major_units(spark, amount, currency, major):
    frame = spark.createDataFrame([(amount, currency)], "a long, c string")
    assert frame.select(major_units(F.col("a"), F.col("c"))).first()[0] == major


def test_flatten_full_and_empty_charge(spark):
    full = {
        "id": "ch_1", "created": 1609459200, "amount": 1000, "amount_refunded": 0, "currency": "aud",
        "status": "succeeded", "captured": True,
        "balance_transaction": {
            "fee": 59,
            "fee_details": [{"type": "tax", "amount": 5}, {"type": "fee", "amount": 54}, {"type": "tax"}],
        },
        "refunds": {"data": [{"created": 1609545600}, {"created": None}, {"created": 1609459201}]},
        "outcome": {"seller_message": "ok"}, "invoice": {"id": "in_9"},
        "metadata": {"OrgName": "Org", "EmailAddress": "person"},
    }
    frame = spark.createDataFrame([(json.dumps(full),), (json.dumps({"id": "ch_2"}),)], "payload string")
    flat = charge_feed.flatten_charges(charge_feed.parse_charges(frame))
    assert tuple(flat.columns) == charge_feed.SNAPSHOT_COLUMNS
    assert not set(flat.columns) & set(charge_feed.PERSON_COLUMNS)
    one, two = flat.orderBy("id").collect()
    assert one["Created date (UTC)"] == "2021-01-01 00:00:00"
    assert one["Refunded date (UTC)"] == "2021-01-01 00:00:01"
    assert (one["Amount"], one["Fee"], one["Taxes On Fee"]) == (10.0, 0.59, 0.05)
    assert (one["Status"], one["Invoice ID"], one["OrgName (metadata)"]) == ("Paid", "in_9", "Org")
    assert (two["Created date (UTC)"], two["Refunded date (UTC)"], two["Status"]) == ("", "", "")
    assert two["Amount"] is None and two["Taxes On Fee"] is None and two["Invoice ID"] is None


def test_feed_order_is_stable(spark):
    rows = [(2, datetime(2021, 1, 1)), (1, datetime(2021, 1, 1)), (3, datetime(2020, 1, 1))]
    frame = spark.createDataFrame(rows, "id long, created timestamp_ntz")
    kept = charge_feed.in_feed_order(charge_feed.history_since(frame, date(2020, 6, 1)))
    assert [r["id"] for r in kept.collect()] == [1, 2]


def test_hot_payer_gives_exact_sums(spark, settings):
    """A third of all rows from one payer: same result as adding everything up by hand."""
    hot = spark.range(4000).select(F.lit(7).alias("payer"), F.col("id"))
    rest = spark.range(8000).select((F.col("id") % 50).cast("int").alias("payer"), F.col("id"))
    rows = hot.unionByName(rest).select(
        "payer",
        (F.lit(datetime(2021, 1, 1)).cast("timestamp_ntz")
         + F.make_dt_interval((F.col("id") % 80).cast("int"))).alias("created"),
        ((F.col("id") % 97) / 4).cast("decimal(18,2)").alias("amount"),
    )
    groups = spark.range(50).select(
        F.col("id").cast("int").alias("payer"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("series_id")
    )
    got = {
        (r["series_id"], r["month"]): r["y"]
        for r in monthly.monthly_sums_via(rows, groups, settings).collect()
    }
    expected: dict = {}
    for r in rows.collect():
        key = (f"g{r['payer'] % 3}", r["created"].date().replace(day=1))
        expected[key] = expected.get(key, 0) + r["amount"]
    assert got == expected
