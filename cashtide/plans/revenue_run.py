"""The whole run: read, validate, clean, monthly series, models, selection, forecast, log.

Raw charges are read once: they are reduced to one row per series, category and month, and the same aggregate
carries the quality rules' failures and the input fingerprint of the rows behind every such row. What is rare stays
countable that way also when tasks are repeated, which counters beside a job do not promise.

A run has four stages, each reading written tables only: ``data``, ``fit``, ``evaluate``, ``forecast``. Tables are
staged and become the newest ones by one commit at the very end, after the gates, so readers never mix two
runs and a run that is blocked or dies moves nothing. :func:`rerun` begins at a later stage, from the tables
that another run has published.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashtide.functions.categories import DEFAULT_RULES, StreamRule, stream_of
from cashtide.operators import backtest, contracts, forecasters, iterative, monthly, outlook
from cashtide.operators import profiles, robust, scores, selection
from cashtide.operators.cleaning import amount_or_zero, is_kept, naive_utc
from cashtide.settings import Settings
from cashtide.sources import charge_feed, run_log, tables
from cashtide.sources.tables import remove_folder

PIPELINE_VERSION = "1"
CATEGORY = "category"
CLOSED_FORM = ("croston", "level", selection.BENCHMARK)
# Series other than the named streams may take any model; ties go to the first.
ANY_SERIES_ORDER = (iterative.ENSEMBLE, "croston", "level")

STAGES = ("data", "fit", "evaluate", "forecast")


@dataclass(frozen=True)
class PublishedRun:
    """What a run leaves behind."""

    run_id: str
    skipped: bool
    rows_in: int = 0
    rows_clean: int = 0
    months: int = 0


@dataclass
class Workspace:
    """The tables of a run so far, by name: its own staged ones and those taken over from another run."""

    spark: SparkSession
    root: str
    run_id: str
    paths: dict[str, str] = field(default_factory=dict)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Stage a table and go on from the written copy, which also cuts the lineage."""
        self.paths[name] = run_log.stage(df, self.root, name, self.run_id)
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])

    def publish(self) -> None:
        run_log.publish(self.spark, self.root, self.run_id, self.paths)


def reduced(
    charges: DataFrame, settings: Settings, rules: tuple[StreamRule, ...] = DEFAULT_RULES, by: str = CATEGORY
) -> DataFrame:
    """All a run needs from the raw charges, in one aggregate: a row per series, category and month of kept charges,
    and one for those that cleaning drops.

    Beside the amounts a row has the number of charges behind it, how many break each rule of the charge contract, and the
    aggregates of the input fingerprint. All add up, so :func:`inspect` reads them from here.
    """
    contracts.require_contract_columns(charges)
    broken = contracts.failure_counts(contracts.charge_rules(settings.as_of))
    # Both lists begin with the number of rows.
    hashes = run_log.fingerprint_aggregates(charges)[1:]
    kept = is_kept(charges.columns, settings)
    category = stream_of(F.col("description"), rules)
    month = monthly.month_of(naive_utc(charges, "created"))
    amount = F.when(kept, amount_or_zero(F.col("amount")))
    only = lambda value, name: F.when(kept, value).alias(name)
    return charges.groupBy(
        kept.alias("kept"),
        only(category if by == CATEGORY else F.col(by), "series_id"),
        only(category, "category"),
        only(month, "month"),
    ).agg(*profiles.amount_aggregates(amount), *broken, *hashes)


def inspect(cells: DataFrame, settings: Settings) -> tuple[str, dict]:
    """(input fingerprint, counts of :func:`cashtide.operators.contracts.judge`) from stored :func:`reduced` rows."""
    rules = contracts.charge_rules(settings.as_of)
    names = ["rows", *(f"n{i}" for i in range(len(rules)))]
    total = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names]
    counted = cells.agg(
        *total, F.sum("hash_sum").alias("hash_sum"), F.bit_xor("hash_xor").alias("hash_xor"), F.max("schema_hash").alias("schema_hash")
    ).first().asDict()
    return run_log.as_text(counted), counted


def stage_data(work: Workspace, cells: DataFrame, settings: Settings, by: str = CATEGORY) -> tuple[DataFrame, int]:
    """The category audit and the monthly series from the kept cells; the long series and the number of charges."""
    contracts.require_rows(cells)
    summary = work.put(profiles.by_total(profiles.summarise_cells(cells)).coalesce(1), "category_summary")
    rows_clean = summary.agg(F.sum("transactions")).first()[0]
    sums = (
        cells.filter(F.col("month") >= F.lit(settings.series_start))
        .groupBy("series_id", "month")
        .agg(F.sum("total").alias("y"))
    )
    streams = settings.streams if by == CATEGORY else None
    # Stored as a row per series, which is how every later stage takes it: none moves rows to bring a series together.
    arrays = work.put(monthly.series_arrays(sums, settings, streams=streams), "series_arrays")
    if arrays.isEmpty():
        raise contracts.ContractError("no series has a complete month, so there is nothing to forecast")
    return work.put(monthly.to_long(arrays), "monthly_long"), rows_clean


def explore(arrays: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(flagged months, break months): Hampel flags on the STL remainder, and PELT breaks.

    ``outlier`` says which flags count: at most ``settings.most_outliers`` a series, and why others do not is to be seen.
    """
    flagged = robust.hampel_flags(
        iterative.stl(arrays, settings), value="remainder", n_sigma=robust.PIPELINE_SIGMA
    )
    kept = robust.keep_strongest(flagged, "remainder", settings.most_outliers).filter("flagged")
    return kept.select("series_id", "month", "remainder", "outlier"), iterative.structural_breaks(arrays)


def backtest_all(
    arrays: DataFrame, settings: Settings, first_breaks: DataFrame | None = None
) -> DataFrame:
    """Backtests of every model a series may be given, and of the benchmark."""
    closed_form = backtest.backtest(arrays, CLOSED_FORM, settings)
    return iterative.ensemble_backtest(arrays, settings, first_breaks).unionByName(closed_form)


def stream_preference() -> Column:
    """The named streams choose between their default and its challenger."""
    return selection.preference(F.col("series_id"), F.col("model"), selection.DEFAULT_PAIRS)


def evaluate(results: DataFrame, rank: Column | None = None) -> DataFrame:
    """Evaluation table of the selected models with their diagnostics."""
    return evaluate_scored(scores.score_with_residuals(results), rank)


def evaluate_scored(scored: DataFrame, rank: Column | None = None) -> DataFrame:
    """The same from ``scores.score_with_residuals``, a row per series and model."""
    chosen = selection.select_model(scored, stream_preference() if rank is None else rank)
    residuals = scored.select("series_id", "model", "residuals").join(
        chosen.select("series_id", "model"), ["series_id", "model"], "left_semi"
    )
    return selection.with_diagnostics(
        selection.evaluation(chosen),
        scores.ljung_box_p(scores.ljung_box(residuals)),
        scores.normality(residuals),
    )


def forecast_selected(
    arrays: DataFrame,
    chosen: DataFrame,
    horizon: int,
    settings: Settings,
    first_breaks: DataFrame | None = None,
) -> DataFrame:
    """Forecast of every series by the model selected for it."""
    ensemble = chosen.filter(F.col("model") == iterative.ENSEMBLE).select("series_id")
    with_ensemble = arrays.join(ensemble, "series_id", "left_semi").select(
        "series_id", "first_month", "ys"
    )
    return outlook.forecast_by_model(
        arrays, chosen, horizon, settings, CLOSED_FORM
    ).unionByName(iterative.ensemble_forecast(with_ensemble, horizon, settings, first_breaks))


def _regressors(work: Workspace, by: str) -> DataFrame:
    """The first break of each series that takes a step regressor: with named streams the recurring one only."""
    first = robust.first_break(work.get("breaks"))
    return first.filter(F.col("series_id") == "recurring") if by == CATEGORY else first


def stage_fit(work: Workspace, settings: Settings, by: str = CATEGORY) -> None:
    """Outliers, breaks, and the backtests of every model a series may be given."""
    arrays = work.get("series_arrays")
    flagged, breaks = explore(arrays, settings)
    flagged = work.put(flagged, "flagged_months")
    work.put(flagged.filter("outlier").select("series_id", "month"), "outliers")
    work.put(breaks, "breaks")
    work.put(backtest_all(arrays, settings, _regressors(work, by)), "backtests")


def stage_evaluate(
    work: Workspace, settings: Settings, prior: DataFrame | None, by: str = CATEGORY, ratio: float = selection.DEFAULT_RATIO
) -> None:
    """Scores, the evaluation table, and the regression gate on it. Backtests are read once, and the table the gate
    has judged is the one that is published."""
    arrays = work.get("series_arrays")
    scored = work.put(scores.score_with_residuals(work.get("backtests")), "scores")
    rank = None if by == CATEGORY else selection.ranked_by(F.col("model"), ANY_SERIES_ORDER)
    table = work.put(selection.for_every_series(evaluate_scored(scored, rank), arrays), "evaluation")
    selection.regression_gate(table, prior, ratio)


def stage_forecast(work: Workspace, settings: Settings, by: str = CATEGORY) -> None:
    """Forecasts of every series by its model. A shorter horizon is the beginning of the longer one."""
    marked = forecasters.with_outlier_positions(work.get("series_arrays"), work.get("outliers"))
    longest = work.put(
        forecast_selected(marked, work.get("evaluation"), settings.long_horizon, settings, _regressors(work, by)),
        f"forecast_{settings.long_horizon}m_long",
    )
    for horizon in (settings.short_horizon, settings.long_horizon):
        part = longest.filter(F.col("step") <= horizon)
        wide = outlook.forecast_table(part, settings.streams) if by == CATEGORY else outlook.total_forecast(part)
        work.put(wide, f"forecast_{horizon}m")


def run(
    charges: DataFrame,
    settings: Settings,
    root: str,
    code_version: str,
    input_source: str = "charges",
    run_id: str | None = None,
    force: bool = False,
    rules: tuple[StreamRule, ...] = DEFAULT_RULES,
    by: str = CATEGORY,
    ratio: float = selection.DEFAULT_RATIO,
    known_fingerprint: str | None = None,
) -> PublishedRun:
    """A full run that publishes its tables below ``root``.

    It is skipped when input, code and settings equal those of the newest run. Gates come before anything is
    published: a run that breaks the charge contract, or whose models got worse than ``ratio`` times their former
    error and worse than the benchmark, leaves all newest tables in place. Series too short for a backtest are
    forecast too, by the model their sparsity asks for; a run without any series fails. ``known_fingerprint``, as
    ``partition_digests.refresh`` keeps it, lets a run be skipped before any charge is read.
    """
    spark = charges.sparkSession
    work = Workspace(spark, root, run_id or run_log.new_run_id())
    log = f"{root}/runs"
    prior = None if force else run_log.last_run(spark, log)
    asked = run_log.settings_digest(settings, rules, by)
    if known_fingerprint and run_log.unchanged(prior, known_fingerprint, code_version, asked):
        return PublishedRun(work.run_id, skipped=True)
    # Split by `kept`, so that the kept cells are a folder of their own.
    reduction = reduced(charges, settings, rules, by)
    path = run_log.stage(reduction, root, "reduction", work.run_id, by=["kept"])
    cells = spark.read.schema(reduction.schema).parquet(path)
    fingerprint, counted = inspect(cells, settings)
    contract = contracts.charge_rules(settings.as_of)
    unchanged = run_log.unchanged(prior, fingerprint, code_version, asked)
    if unchanged or any(counted[f"n{i}"] for i in range(len(contract))):
        remove_folder(spark, path)
        if unchanged:
            return PublishedRun(work.run_id, skipped=True)
        contracts.enforce(charges, contract)  # reads again, for offending values to name

    work.paths["monthly_cells"] = f"{path}/kept=true"
    long, rows_clean = stage_data(work, cells.filter("kept"), settings, by)
    stage_fit(work, settings, by)
    stage_evaluate(work, settings, run_log.prior_mase(spark, log, root), by, ratio)
    stage_forecast(work, settings, by)
    work.publish()

    span = long.agg(F.max("month").cast("string").alias("last"), F.max("idx").alias("idx")).first()
    facts = dict(
        input_source=input_source, input_fingerprint=fingerprint, data_through=span["last"],
        rows_in=counted["rows"], rows_clean=rows_clean, months=span["idx"] + 1,
    )
    _log(work, log, code_version, asked, settings, by, facts)
    return PublishedRun(work.run_id, False, counted["rows"], rows_clean, span["idx"] + 1)


def run_from(
    spark: SparkSession,
    candidates: Sequence[tuple[str, str]],
    schema: str | T.StructType,
    settings: Settings,
    root: str,
    code_version: str,
    fmt: str = "csv",
    **options,
) -> PublishedRun:
    """A run over the first source that exists of ``(label, path)`` candidates, a fresh snapshot before the history.

    The label is recorded as the run's input source. ``schema`` names snapshot columns, those of the charge contract
    among them; ``options`` are those of :func:`run`.
    """
    required = charge_feed.CHARGE_COLUMNS
    found = tables.read_preferred(spark, candidates, schema, required, fmt)
    # Every row has the label; the plan knows it without reading one.
    label = next(name for name, path in candidates if tables.path_exists(spark, path))
    charges = charge_feed.charges_from_snapshot(found.drop("input_source", "input_path"), label)
    return run(charges, settings, root, code_version, input_source=label, **options)


def _log(work: Workspace, log: str, code_version: str, asked: str, settings: Settings, by: str, facts: dict) -> None:
    record = run_log.run_record(
        work.spark,
        run_id=work.run_id,
        code_version=code_version,
        pipeline_version=PIPELINE_VERSION,
        settings=asked,
        evaluated=work.get("evaluation"),
        streams=settings.streams if by == CATEGORY else (),
        **facts,
    )
    run_log.append_run(record, log)


def rerun(
    spark: SparkSession,
    stage: str,
    settings: Settings,
    root: str,
    code_version: str,
    charges: DataFrame | None = None,
    run_id: str | None = None,
    rules: tuple[StreamRule, ...] = DEFAULT_RULES,
    by: str = CATEGORY,
    ratio: float = selection.DEFAULT_RATIO,
) -> PublishedRun:
    """Run ``stage`` (``fit``, ``evaluate`` or ``forecast``) and those after it, from the newest run's tables.

    The outcome is that of a full run over the same input. Tables made with other settings are refused, and with
    ``charges`` given also tables made from another input; reading the charges for that is the only time they
    are needed. Tables that are taken over are published again with the new ones, as one run.
    """
    if stage not in STAGES[1:]:
        raise ValueError(f"a rerun begins at one of {STAGES[1:]}, not at {stage!r}")
    log = f"{root}/runs"
    prior = run_log.last_run(spark, log)
    if prior is None:
        raise FileNotFoundError(f"no run below {root} whose tables could be used")
    asked = run_log.settings_digest(settings, rules, by)
    if prior["settings_digest"] != asked:
        raise run_log.StaleModelError(f"the tables of run {prior['run_id']} were made with other settings: run again")
    if charges is not None:
        run_log.require_fresh(prior["input_fingerprint"], run_log.fingerprint_text(charges))
    work = Workspace(spark, root, run_id or run_log.new_run_id(), run_log.published_tables(spark, root, prior["run_id"]))
    if stage == "fit":
        stage_fit(work, settings, by)
    if stage in ("fit", "evaluate"):
        stage_evaluate(work, settings, run_log.prior_mase(spark, log, root), by, ratio)
    stage_forecast(work, settings, by)
    work.publish()
    facts = {k: prior[k] for k in ("input_source", "input_fingerprint", "data_through", "rows_in", "rows_clean", "months")}
    _log(work, log, code_version, asked, settings, by, facts)
    return PublishedRun(work.run_id, False, prior["rows_in"], prior["rows_clean"], prior["months"])
