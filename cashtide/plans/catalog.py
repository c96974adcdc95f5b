"""The query catalog: every operator run over the test tables.

A query is registered with the layout of its result. In a layout, ``name@`` is a date or time
shown as ISO text, ``name~4`` a number rounded to four decimals, ``name#`` a whole number.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.functions.categories import stream_of
from cashtide.functions.charge_fields import major_units
from cashtide.functions.clock import utc_instant, utc_wall_clock
from cashtide.operators import backtest as bt
from cashtide.operators import contracts, drift, forecasters, iterative, kpis, monthly
from cashtide.operators import outlook, profiles, robust, scores, selection
from cashtide.operators.cleaning import dropped_currency_audit
from cashtide.plans import demo_tables as demo
from cashtide.plans import revenue_run
from cashtide.plans.demo_tables import DEMO
from cashtide.session import scratch_dir
from cashtide.sources import charge_feed, run_log
from cashtide.streaming import revenue

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
LAYOUTS: dict[str, list[str]] = {}

# Stand-in routes whose forecasts can be checked in SQL.
ROUTES = {"league": "croston", "recurring": "seasonal_naive", "one_time": "level"}
CANDIDATES = ("level", "croston")
SQL_MODELS = (*CANDIDATES, selection.BENCHMARK)
DISPLAY = {"recurring": "subscriptions", "one_time": "subscriptions"}
DISPLAY_STREAMS = ["subscriptions", "league"]
PATH = "step# month@ yhat~4 lo80~4 hi80~4 lo95~4 hi95~4"
SCENARIOS = "bear~2 base~2 bull~2"


def present(df: DataFrame, layout: list[str]) -> DataFrame:
    """The result in its published form."""

    def column(entry: str) -> Column:
        name, _, digits = entry.partition("~")
        plain = name.rstrip("@#")
        value = F.col(f"`{plain}`")
        if digits:
            value = F.round(value.cast("double"), int(digits))
        elif name.endswith("@"):
            value = value.cast("string")
        elif name.endswith("#"):
            value = value.cast("long")
        return value.alias(plain)

    return df.select(*[column(entry) for entry in layout])


def query(layout: str | list[str], name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""
    entries = layout.split() if isinstance(layout, str) else layout

    def register(build: Query) -> Query:
        key = name or build.__name__
        LAYOUTS[key] = entries
        QUERIES[key] = lambda spark, sf_dir: present(build(spark, sf_dir), entries)
        return build

    return register


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written once below the shared folder, as a run stages its tables."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- shared inputs ---------------------------------------------------------------------------


def category_sums(spark, sf_dir):
    return monthly.monthly_sums(demo.cleaned(spark, sf_dir), DEMO)


def category_arrays(spark, sf_dir):
    return monthly.series_arrays(category_sums(spark, sf_dir), DEMO, streams=DEMO.streams)


def category_long(spark, sf_dir):
    return monthly.to_long(category_arrays(spark, sf_dir))


def group_sums(spark, sf_dir):
    """By segment and nation: many dense series."""
    return monthly.monthly_sums_via(
        demo.cleaned(spark, sf_dir), demo.payer_groups(spark, sf_dir), DEMO
    )


def group_arrays(spark, sf_dir):
    return monthly.series_arrays(group_sums(spark, sf_dir), DEMO)


def group_long(spark, sf_dir):
    return monthly.to_long(group_arrays(spark, sf_dir))


def payer_sums(spark, sf_dir):
    """By payer: as many sparse series as there are customers."""
    return monthly.monthly_sums(demo.cleaned(spark, sf_dir), DEMO, by="payer")


def group_flags(spark, sf_dir):
    """Hampel flags on the raw values, the stand-in for the outlier table."""
    return robust.hampel_flags(group_long(spark, sf_dir))


def group_outliers(spark, sf_dir):
    return group_flags(spark, sf_dir).filter("flagged").select("series_id", "month")


def group_breaks(spark, sf_dir):
    """First flagged month per series, the stand-in for the break table."""
    return robust.first_break(group_outliers(spark, sf_dir))


def routes(spark):
    return spark.createDataFrame(list(ROUTES.items()), "series_id string, model string")


def stream_forecast(spark, sf_dir, horizon):
    return outlook.forecast_by_model(
        category_arrays(spark, sf_dir), routes(spark), horizon, DEMO, tuple(ROUTES.values())
    )


def total_forecast(spark, sf_dir, horizon):
    return outlook.total_forecast(stream_forecast(spark, sf_dir, horizon))


def total_line(spark, sf_dir, horizon=12):
    history = kpis.total_series(category_long(spark, sf_dir))
    planned = kpis.total_series(stream_forecast(spark, sf_dir, horizon), ("yhat", "lo80", "hi80"))
    return kpis.timeline(history, planned)


def display_line(spark, sf_dir, horizon=12):
    history = kpis.combine_streams(category_long(spark, sf_dir), DISPLAY)
    planned = kpis.combine_streams(
        stream_forecast(spark, sf_dir, horizon), DISPLAY, ("yhat", "lo80", "hi80")
    )
    return kpis.timeline(history, planned)


def group_results(spark, sf_dir, models=SQL_MODELS):
    return bt.backtest(group_arrays(spark, sf_dir), models, DEMO)


def group_scores(spark, sf_dir):
    return scores.score(group_results(spark, sf_dir))


def chosen_models(scored):
    return selection.select_model(scored, selection.ranked_by(F.col("model"), CANDIDATES))


def group_evaluation(spark, sf_dir):
    return selection.evaluation(chosen_models(group_scores(spark, sf_dir)))


def valid_requests(spark, sf_dir):
    requests = contracts.with_default_level(demo.forecast_requests(spark, sf_dir))
    return contracts.split_valid(requests, contracts.request_rules())[0]


def scored_requests(spark, sf_dir):
    return outlook.score_requests(
        valid_requests(spark, sf_dir), total_forecast(spark, sf_dir, 24), keep=("asked_at",)
    )


# ---- sources, projections, filters -----------------------------------------------------------


def _snapshot_layout() -> list[str]:
    numbers = {"Amount", "Amount Refunded", "Fee", "Taxes On Fee", "Converted Amount",
               "Converted Amount Refunded"}
    return [f"{c}~2" if c in numbers else c for c in charge_feed.SNAPSHOT_COLUMNS]


@query(_snapshot_layout())
def charge_flatten(spark, sf_dir):
    return charge_feed.flatten_charges(charge_feed.parse_charges(demo.charge_objects(spark, sf_dir)))


@query(_snapshot_layout())
def pii_projection(spark, sf_dir):
    return charge_feed.minimise(demo.person_extract(spark, sf_dir))


@query("id# created@ amount~2")
def charge_history(spark, sf_dir):
    charges = charge_feed.history_since(demo.charges(spark, sf_dir), date(1998, 1, 1))
    return charge_feed.in_feed_order(charges)


@query("id# currency minor# major~2")
def minor_to_major(spark, sf_dir):
    currency = F.when(F.col("o_custkey") % 20 == 3, "jpy").otherwise(demo.order_currency())
    minor = F.round(F.col("o_totalprice") * 100).cast("long")
    return demo.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        currency.alias("currency"),
        minor.alias("minor"),
        major_units(minor, currency).alias("major"),
    )


@query("id# description category")
def categorise(spark, sf_dir):
    return demo.charges(spark, sf_dir).withColumn("category", stream_of(F.col("description")))


@query("id# created@ amount~2 category description")
def clean_charges(spark, sf_dir):
    return demo.cleaned(spark, sf_dir)


@query("currency dropped_rows# dropped_amount~2", "dropped_currency_audit")
def dropped_currencies(spark, sf_dir):
    return dropped_currency_audit(demo.charges(spark, sf_dir), DEMO)


@query("month@ league~2 recurring~2 one_time~2")
def monthly_wide(spark, sf_dir):
    return monthly.widen(category_long(spark, sf_dir), DEMO.streams)


@query("month@ series_id y~2")
def series_unpivot(spark, sf_dir):
    wide = monthly.widen(category_long(spark, sf_dir), DEMO.streams)
    return monthly.unpivot_streams(wide, DEMO.streams)


@query(
    "month@ league~2 recurring~2 one_time~2 disrupted# league_log~9 recurring_log~9 "
    "one_time_log~9 total~2"
)
def features(spark, sf_dir):
    wide = monthly.widen(category_long(spark, sf_dir), DEMO.streams)
    return monthly.add_features(wide, DEMO)


@query("series_id month@ y~2 indicator#")
def outlier_dummies(spark, sf_dir):
    return robust.outlier_indicators(group_long(spark, sf_dir), group_outliers(spark, sf_dir))


@query("series_id month@ y~2 break_month@ post_break~1")
def step_dummy(spark, sf_dir):
    return robust.step_dummy(group_long(spark, sf_dir), group_breaks(spark, sf_dir))


@query("series_id step# month@ floor~6 yhat~6")
def forecast_floor(spark, sf_dir):
    """Drift forecasts lifted to a quarter of the recent median."""
    ys = F.col("ys")
    path = forecasters.apply_floor(forecasters.drift_path(ys, 24, DEMO), ys)
    rows = group_arrays(spark, sf_dir).withColumn("path", path)
    return forecasters.explode_path(
        rows.withColumn("floor", forecasters.recent_floor(ys)),
        ("series_id", "floor"),
        forecasters.last_known_month(),
    )


# ---- quality gates ---------------------------------------------------------------------------


def extract_rules():
    return contracts.charge_rules(date(2001, 6, 30), earliest_year=1996)


@query("rule column rows# failures# sample")
def dq_report(spark, sf_dir):
    return contracts.quality_report(demo.raw_extract(spark, sf_dir), extract_rules())


@query("id# reasons")
def dq_quarantine(spark, sf_dir):
    _, bad = contracts.split_valid(demo.raw_extract(spark, sf_dir), extract_rules())
    return bad.withColumn("reasons", F.concat_ws(",", "reasons"))


@query("request_id# horizon# level# valid reasons")
def request_validate(spark, sf_dir):
    requests = contracts.with_default_level(demo.forecast_requests(spark, sf_dir))
    judged = contracts.with_reasons(requests, contracts.request_rules())
    return judged.withColumn("valid", F.size("reasons") == 0).withColumn(
        "reasons", F.concat_ws(",", "reasons")
    )


@query("request_id# horizon# months# finite non_negative ordered complete accepted")
def forecast_contract(spark, sf_dir):
    return contracts.forecast_contract(scored_requests(spark, sf_dir))


# ---- aggregations ----------------------------------------------------------------------------


@query("series_id month@ y~2")
def monthly_long(spark, sf_dir):
    return category_sums(spark, sf_dir)


@query("series_id month@ y~2")
def monthly_long_groups(spark, sf_dir):
    return group_sums(spark, sf_dir)


@query("category transactions# total~2 average~2 smallest~2 largest~2 share_pct~1")
def category_summary(spark, sf_dir):
    return profiles.category_summary(demo.cleaned(spark, sf_dir))


@query(
    "series_id total~2 nonzero_months# months# lowest~2 highest~2 first_month@ data_through@"
)
def series_profile(spark, sf_dir):
    return profiles.series_profile(group_long(spark, sf_dir))


@query("series_id# nonzero_months# nonzero_frac~9 route")
def sparsity_route(spark, sf_dir):
    sums = payer_sums(spark, sf_dir)
    return profiles.sparsity_route(
        monthly.demand_months(sums, DEMO), monthly.calendar_length(sums, DEMO)
    )


@query(f"year# quarter# months# {SCENARIOS}")
def quarterly_scenarios(spark, sf_dir):
    return kpis.quarterly_scenarios(total_forecast(spark, sf_dir, 24))


@query(f"year# quarter# months# {SCENARIOS}")
def full_quarters(spark, sf_dir):
    return kpis.quarterly_scenarios(total_forecast(spark, sf_dir, 24), full_only=True)


@query(f"months# {SCENARIOS}")
def annual_totals(spark, sf_dir):
    return kpis.annual_totals(total_forecast(spark, sf_dir, 12))


@query("series_id forecast_sum~2 share_pct~6")
def stream_mix(spark, sf_dir):
    return kpis.stream_mix(stream_forecast(spark, sf_dir, 12))


@query(
    "series_id year# ytd_months# ytd_actual~2 prior_ytd~2 remaining~2 yoy_pct~6 full_year~2"
)
def ytd_tracker(spark, sf_dir):
    return kpis.ytd_tracker(total_line(spark, sf_dir))


@query("series_id prior_year~2 base~2 bear~2 bull~2 spread~2 pct_vs_prior~6")
def vs_prior_year(spark, sf_dir):
    return kpis.vs_prior_year(total_line(spark, sf_dir))


@query("series_id forecast_sum~2 forecast_mean~4 last12_mean~4 pct_vs_last12~6")
def stream_kpi(spark, sf_dir):
    return kpis.stream_kpi(display_line(spark, sf_dir))


@query("series_id mean_all~8 mean_positive~8 median_positive~3")
def stream_baselines(spark, sf_dir):
    return profiles.stream_baselines(group_long(spark, sf_dir), DEMO)


@query("beating# models#")
def beats_summary(spark, sf_dir):
    return selection.beats_summary(group_evaluation(spark, sf_dir))


# ---- joins -----------------------------------------------------------------------------------


@query("series_id month@ idx# y~2")
def calendar_fill(spark, sf_dir):
    return group_long(spark, sf_dir)


@query("series_id month@ y~2 stream_median~3 pct_above~6")
def outlier_context(spark, sf_dir):
    return robust.outlier_context(
        group_long(spark, sf_dir), group_outliers(spark, sf_dir), DEMO
    )


@query("request_id# horizon# level# step# month@ yhat~2 lo~2 hi~2")
def score_requests(spark, sf_dir):
    return scored_requests(spark, sf_dir)


@query("request_id# horizon# level# step# month@ yhat~2 lo~2 hi~2")
def serve_requests(spark, sf_dir):
    """The same answers by the serving plan, which refuses what breaks the contract, without a shuffle of requests."""
    requests = demo.forecast_requests(spark, sf_dir).drop("asked_at")
    return outlook.serve(requests, total_forecast(spark, sf_dir, 24))[0]


@query("series_id prior_mase~4 mase~4 baseline_mase~4 ratio~5 verdict")
def regression_gate(spark, sf_dir):
    # The stand-in for the prior run is made from the table too; the backtests below it are run once.
    table = stored(group_evaluation(spark, sf_dir), "evaluation")
    slot = F.length("series_id") % 3
    prior = table.select(
        "series_id",
        F.round(F.when(slot == 0, F.col("mase") * 0.6).when(slot == 1, F.col("mase")), 4).alias(
            "prior_mase"
        ),
    )
    return selection.regression_report(table, prior)


@query("series_id train_end# test_end# train_months# test_months# train_total~2 test_total~2")
def cv_windows(spark, sf_dir):
    return bt.window_table(group_arrays(spark, sf_dir), DEMO)


@query("series_id month@ kind y~2")
def history_bridge(spark, sf_dir):
    return kpis.history_bridge(display_line(spark, sf_dir))


# ---- windows ---------------------------------------------------------------------------------


@query("series_id month@ y~2 median~3")
def rolling_median(spark, sf_dir):
    return robust.rolling_median(group_long(spark, sf_dir))


@query("series_id month@ y~2 median~3 deviation~3 mad~4 flagged")
def hampel_flags(spark, sf_dir):
    return group_flags(spark, sf_dir)


@query("series_id month@ y~2 flagged outlier")
def outlier_topk(spark, sf_dir):
    return robust.keep_strongest(group_flags(spark, sf_dir), limit=3)


@query("series_id scale~4")
def mase_scale(spark, sf_dir):
    return group_arrays(spark, sf_dir).withColumn("scale", bt.mase_scale(F.col("ys"), DEMO))


@query(f"month@ {SCENARIOS} bear_cum~2 base_cum~2 bull_cum~2")
def cumulative_scenarios(spark, sf_dir):
    return kpis.cumulative_scenarios(total_forecast(spark, sf_dir, 24))


@query("series_id mom_growth_pct~6")
def mom_growth(spark, sf_dir):
    return kpis.mom_growth(group_long(spark, sf_dir))


@query(
    "series_id recent6_mean~4 prior6_mean~4 last12~2 next12~2 momentum_pct~6 outlook_pct~6 status"
)
def stream_health(spark, sf_dir):
    return kpis.stream_health(display_line(spark, sf_dir))


@query("month@ total~2 year_ago~2 subscriptions~2 league~2 yoy_pct~6 subscriptions_pct~6 league_pct~6")
def latest_month(spark, sf_dir):
    return kpis.latest_month(
        kpis.combine_streams(category_long(spark, sf_dir), DISPLAY), DISPLAY_STREAMS
    )


@query("series_id peak_month@ peak~4 average~4")
def peak_month(spark, sf_dir):
    return kpis.peak_month(stream_forecast(spark, sf_dir, 12))


@query(f"period {SCENARIOS} spread~2 downside~2 upside~2 band")
def spread_bands(spark, sf_dir):
    return kpis.spread_bands(total_forecast(spark, sf_dir, 12))


@query("series_id month@ idx# y~2")
def history_tail(spark, sf_dir):
    return monthly.history_tail(group_long(spark, sf_dir))


@query("first_base~2 last_base~2 declining")
def trend_caution(spark, sf_dir):
    return kpis.trend_caution(total_forecast(spark, sf_dir, 24))


@query("series_id break_month@")
def first_break(spark, sf_dir):
    return group_breaks(spark, sf_dir)


# ---- forecasts -------------------------------------------------------------------------------


def _baseline(model):
    return lambda spark, sf_dir: forecasters.forecast(group_arrays(spark, sf_dir), model, 24, DEMO)


for _key, _model in (
    ("baseline_mean", "mean"),
    ("baseline_snaive", "seasonal_naive"),
    ("baseline_drift", "drift"),
):
    query("series_id step# month@ yhat~4", _key)(_baseline(_model))


def payer_rates(spark, sf_dir):
    sums = payer_sums(spark, sf_dir)
    return forecasters.croston_rates(
        monthly.demand_months(sums, DEMO), monthly.calendar_length(sums, DEMO)
    )


@query("series_id# demand_months# rate~6")
def croston(spark, sf_dir):
    return payer_rates(spark, sf_dir)


@query("series_id# rate~5 spread~5 lo80~5 hi80~5 lo95~5 hi95~5")
def croston_interval(spark, sf_dir):
    return forecasters.with_bounds(payer_rates(spark, sf_dir))


@query(f"series_id {PATH}")
def level_forecast(spark, sf_dir):
    arrays = forecasters.with_outlier_positions(
        group_arrays(spark, sf_dir), group_outliers(spark, sf_dir)
    )
    return forecasters.level_forecast(arrays, 12, DEMO)


@query("series_id train_end# level~4 lo80~4 hi80~4")
def level_cv(spark, sf_dir):
    return (
        group_results(spark, sf_dir, ("level",))
        .filter(F.col("step") == 1)
        .withColumnRenamed("yhat", "level")
    )


@query("series_id step# yhat~4 lo80_median~4 hi95_median~4 lo80_mean~4 hi95_mean~4")
def ensemble_combine(spark, sf_dir):
    """Both combinations, over members whose numbers SQL can follow."""
    ys = F.col("ys")
    members = [
        forecasters.FORECASTERS[name](ys, 12, DEMO)
        for name in ("level", "croston", "seasonal_naive")
    ]
    rows = group_arrays(spark, sf_dir).select(
        "series_id",
        F.explode(
            F.arrays_zip(
                forecasters.combine_paths(*members, bounds="median").alias("f"),
                forecasters.combine_paths(*members, bounds="mean").alias("b"),
            )
        ).alias("e"),
    )
    return rows.select(
        "series_id",
        F.col("e.f.step").alias("step"),
        F.col("e.f.yhat").alias("yhat"),
        F.col("e.f.lo80").alias("lo80_median"),
        F.col("e.f.hi95").alias("hi95_median"),
        F.col("e.b.lo80").alias("lo80_mean"),
        F.col("e.b.hi95").alias("hi95_mean"),
    )


@query("series_id model n_train# nonzero_pct#")
def model_spec(spark, sf_dir):
    # Forecasting and selection read the same arrays; the shuffle below them is shared.
    return profiles.model_spec(
        group_arrays(spark, sf_dir), chosen_models(group_scores(spark, sf_dir))
    )


@query(f"series_id model {PATH}")
def forecast_12m(spark, sf_dir):
    arrays = category_arrays(spark, sf_dir)
    results = bt.backtest(arrays, SQL_MODELS, DEMO)
    chosen = chosen_models(scores.score(results))
    return outlook.forecast_by_model(arrays, chosen, DEMO.short_horizon, DEMO, CANDIDATES)


def group_forecast(spark, sf_dir, horizon):
    chosen = chosen_models(group_scores(spark, sf_dir))
    return outlook.forecast_by_model(
        group_arrays(spark, sf_dir), chosen, horizon, DEMO, CANDIDATES
    )


@query(f"series_id model {PATH}")
def forecast_24m(spark, sf_dir):
    return group_forecast(spark, sf_dir, DEMO.long_horizon)


@query(f"step# month@ total~2 lo80~2 hi80~2 lo95~2 hi95~2 {SCENARIOS}", "forecast_total")
def forecast_total_(spark, sf_dir):
    return outlook.total_forecast(group_forecast(spark, sf_dir, DEMO.long_horizon))


@query(
    "month@ league~2 recurring~2 one_time~2 total_base~2 total_lo80~2 total_hi80~2 total_lo95~2 "
    f"total_hi95~2 {SCENARIOS}"
)
def forecast_table(spark, sf_dir):
    return outlook.forecast_table(stream_forecast(spark, sf_dir, 12), DEMO.streams)


# ---- backtests, scores, diagnostics ----------------------------------------------------------


def _cv(model):
    return lambda spark, sf_dir: group_results(spark, sf_dir, (model,))


for _key, _model, _bounds in (
    ("cv_snaive", "seasonal_naive", ""),
    ("cv_croston", "croston", ""),
    ("cv_level", "level", " lo80~3 hi80~3"),
):
    query(f"series_id model train_end# step# month@ y~2 yhat~3{_bounds}", _key)(_cv(_model))


@query("series_id model n# mase~6")
def metric_mase(spark, sf_dir):
    return group_scores(spark, sf_dir)


@query("series_id model rmse~4")
def metric_rmse(spark, sf_dir):
    return group_scores(spark, sf_dir)


@query("series_id model winkler80~3")
def metric_winkler(spark, sf_dir):
    return scores.score(group_results(spark, sf_dir, ("level",)))


@query("series_id lag# acf~9")
def acf(spark, sf_dir):
    return scores.acf(group_arrays(spark, sf_dir))


@query("series_id lag# pacf~9")
def pacf(spark, sf_dir):
    return scores.pacf(group_arrays(spark, sf_dir))


def level_residuals(spark, sf_dir):
    return scores.residual_arrays(group_results(spark, sf_dir, ("level",)))


@query("series_id model lag# q~6")
def ljung_box_q(spark, sf_dir):
    return scores.ljung_box(level_residuals(spark, sf_dir))


@query("series_id model ljung_box_p~9")
def ljung_box_p(spark, sf_dir):
    return scores.ljung_box_p(scores.ljung_box(level_residuals(spark, sf_dir)))


@query("series_id model shapiro_p~9")
def shapiro(spark, sf_dir):
    return scores.normality(level_residuals(spark, sf_dir))


@query("series_id model mase~6")
def select_model(spark, sf_dir):
    return chosen_models(group_scores(spark, sf_dir))


@query("series_id model mase~4 rmse~2 winkler80~2 baseline_mase~4 beats_baseline")
def evaluation(spark, sf_dir):
    return group_evaluation(spark, sf_dir)


@query("series_id model grade strong gap_pct~6 error_pct~6")
def accuracy_grade(spark, sf_dir):
    baselines = profiles.stream_baselines(group_long(spark, sf_dir), DEMO)
    return selection.accuracy_grade(group_evaluation(spark, sf_dir), baselines)


# ---- iterative numerics ----------------------------------------------------------------------


def _fitted(rows, column):
    return rows.select("series_id", f"{column}.spec", f"{column}.aicc", f"{column}.yhat")


def _fit_rows(rows, column):
    return _fitted(rows, column).select(
        "series_id", "spec", "aicc", F.posexplode("yhat").alias("pos", "yhat")
    ).withColumn("step", F.col("pos") + 1)


@query("series_id spec aicc~3 step# yhat~2")
def arima_grid(spark, sf_dir):
    rows = iterative.spread_out(group_arrays(spark, sf_dir), "series_id")
    return _fit_rows(iterative.arima_fit(rows, ("series_id",), 12, DEMO), "arima")


@query("series_id spec aicc~3 step# yhat~2")
def ets_grid(spark, sf_dir):
    rows = iterative.spread_out(group_arrays(spark, sf_dir), "series_id")
    return _fit_rows(iterative.ets_fit(rows, ("series_id",), 12, DEMO), "ets")


@query("series_id spec aicc~3 step# yhat~2")
def theta(spark, sf_dir):
    rows = iterative.spread_out(group_arrays(spark, sf_dir), "series_id")
    return _fit_rows(iterative.theta_fit(rows, 12, DEMO), "theta")


@query("series_id month@ y~2 trend~4 seasonal~4 remainder~4")
def stl(spark, sf_dir):
    return iterative.stl(group_arrays(spark, sf_dir), DEMO)


@query("series_id month@ remainder~4")
def stl_outliers(spark, sf_dir):
    """The pipeline's outlier rule: Hampel on the STL remainder, at most five per series."""
    flagged = robust.hampel_flags(
        iterative.stl(group_arrays(spark, sf_dir), DEMO),
        value="remainder",
        n_sigma=robust.PIPELINE_SIGMA,
    )
    return robust.keep_strongest(flagged, value="remainder").filter("outlier")


@query("series_id month@ segment_end#")
def breaks(spark, sf_dir):
    """At a lower penalty than the pipeline's, so that the test tables have breaks."""
    return iterative.structural_breaks(group_arrays(spark, sf_dir), penalty=1.0)


@query("series_id n_train# nonzero_pct# arima_order arima_aicc~1 ets_method ets_aicc~1 theta_method")
def model_info(spark, sf_dir):
    return iterative.member_facts(category_arrays(spark, sf_dir), DEMO)


@query("series_id n_train# nonzero_pct# break_month@ theta_method")
def model_facts(spark, sf_dir):
    """What is known of every series and its theta member, without the fitted orders."""
    arrays = group_arrays(spark, sf_dir).join(group_breaks(spark, sf_dir), "series_id", "left")
    return iterative.series_facts(arrays, DEMO)


@query("series_id model train_end# step# month@ y~2 yhat~2 lo80~2 hi80~2")
def cv_ensemble(spark, sf_dir):
    return iterative.ensemble_backtest(category_arrays(spark, sf_dir), DEMO)


@query(f"series_id model {PATH}")
def forecast_ensemble(spark, sf_dir):
    return iterative.ensemble_forecast(group_arrays(spark, sf_dir), 24, DEMO)


@query(
    "series_id model mase~4 rmse~2 winkler80~2 baseline_mase~4 beats_baseline ljung_box_p~4 "
    "shapiro_p~4 residuals_white_noise residuals_normal"
)
def evaluation_full(spark, sf_dir):
    """The published evaluation: every model incl. the ensemble, selection and diagnostics."""
    results = revenue_run.backtest_all(category_arrays(spark, sf_dir), DEMO)
    # Selection and diagnostics read the scores; they are written once.
    return revenue_run.evaluate_scored(stored(scores.score_with_residuals(results), "scores"))


# ---- provenance and drift --------------------------------------------------------------------


@query("rows# hash_sum hash_xor#")
def content_fingerprint(spark, sf_dir):
    printed = run_log.fingerprint(demo.charges(spark, sf_dir))
    return printed.withColumn("hash_sum", F.col("hash_sum").cast("string"))


@query("request model version# run_id")
def resolve_version(spark, sf_dir):
    requests = spark.createDataFrame([("latest",), ("champion",), ("17",)], "request string")
    return run_log.resolve_requests(demo.model_versions(spark, sf_dir), requests, "intervals-v1")


@query("column psi~9 values# reference_rows# current_rows#")
def psi(spark, sf_dir):
    return drift.psi(demo.drift_samples(spark, sf_dir), ("event_type", "k"))


@query("column psi~9 bins# reference_rows# current_rows#")
def psi_binned(spark, sf_dir):
    """Drift of continuous columns over bins of the reference period."""
    return drift.psi_binned(demo.drift_samples(spark, sf_dir), ("value", "user_id"))


@query("column psi~9 drifted threshold~2 drifted_columns# drifted_share~6")
def drift_report(spark, sf_dir):
    return drift.drift_report(
        drift.psi(demo.drift_samples(spark, sf_dir), ("event_type", "k")), threshold=0.02
    )


@query("request_id# step# prediction~2")
def prediction_expand(spark, sf_dir):
    return scored_requests(spark, sf_dir).withColumnRenamed("yhat", "prediction")


@query("column psi~9 values# reference_rows# current_rows#")
def served_drift(spark, sf_dir):
    """Drift of what was asked and of what was answered, between two serving periods.

    Equal requests get equal answers, so requests are counted first and the answers of each kind
    of request expanded once, with the count as weight.
    """
    asked = F.when(
        F.col("asked_at") < F.lit("1998-07-01 00:00:00").cast("timestamp_ntz"), drift.REFERENCE
    ).otherwise(drift.CURRENT)
    kinds = (
        valid_requests(spark, sf_dir)
        .groupBy(asked.alias("period"), "horizon", "level")
        .agg(F.count("*").alias("times"), F.min("request_id").alias("request_id"))
    )
    answers = outlook.score_requests(
        kinds, total_forecast(spark, sf_dir, 24), keep=("period", "times")
    ).withColumn("prediction", F.col("yhat").cast("decimal(18,2)"))
    return drift.psi(kinds, ("horizon",), weight="times").unionByName(
        drift.psi(answers, ("prediction",), weight="times")
    )


# ---- streaming -------------------------------------------------------------------------------


def event_stream(spark, sf_dir):
    stream = revenue.file_stream(spark, sf_dir, demo.SCHEMAS["events"], "events.parquet")
    return stream.withColumn("ts", utc_instant(F.col("ts")))


@query("event_id# ts@ event_type value~2")
def stream_ingest(spark, sf_dir):
    """Every event is delivered twice and kept once."""
    twice = event_stream(spark, sf_dir).unionByName(event_stream(spark, sf_dir))
    return revenue.ingested(twice, "event_id", "ts").withColumn("ts", utc_wall_clock(F.col("ts")))


@query("window_start@ category n# revenue~2")
def stream_windowed(spark, sf_dir):
    windows = revenue.windowed_revenue(event_stream(spark, sf_dir), "event_type", "value", "ts")
    return revenue.windows_of(windows).withColumn(
        "window_start", utc_wall_clock(F.col("window_start"))
    )


@query("sink event_type n# total~2")
def stream_quarantine(spark, sf_dir):
    rules = [
        contracts.Rule("value_in_range", "value", F.col("value").between(1.0, 120.0)),
        contracts.Rule("known_type", "event_type", F.col("event_type") != "error"),
    ]
    root = scratch_dir(spark, "quarantine")
    good, bad = f"{root}/good", f"{root}/bad"
    revenue.quarantine_to(
        event_stream(spark, sf_dir), rules, good, bad, f"{root}/checkpoint"
    ).awaitTermination()
    sinks = revenue.read_judged(spark, good, bad, "event_id long, event_type string, value double, batch_id long")
    return (
        sinks[0].withColumn("sink", F.lit("good"))
        .unionByName(sinks[1].withColumn("sink", F.lit("quarantine")))
        .groupBy("sink", "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    )
