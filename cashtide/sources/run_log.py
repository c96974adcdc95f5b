"""Versioned outputs, run provenance, input fingerprints and the gates that use them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.sources.ledger import FOLDER, Ledger, Part
from cashtide.sources.tables import path_exists

SCHEMA_VERSION = 1

WRITE_OPTIONS = {"csv": {"header": "true"}, "json": {"ignoreNullFields": "false"}}

RUN_SCHEMA = """
    schema_version int, run_id string, run_at string, code_version string,
    pipeline_version string, input_source string, input_fingerprint string, data_through string,
    rows_in bigint, rows_clean bigint, months int, settings_digest string,
    model_selections map<string, string>,
    metrics map<string, struct<mase: double, rmse: double, winkler80: double,
                               ljung_box_p: double, beats_baseline: boolean>>
"""


def new_run_id(moment: datetime | None = None) -> str:
    """UTC time as a run id, for example 20260716T101500Z."""
    return (moment or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")


def fingerprint_aggregates(df: DataFrame) -> list[Column]:
    """Aggregates whose values do not depend on the order of the rows."""
    # A hash passes over NULLs, so each value is hashed with a mark that says whether it is one.
    marked = [x for c in sorted(df.columns) for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    row_hash = F.xxhash64(*marked)
    columns = sorted(f"{field.name}:{field.dataType.simpleString()}" for field in df.schema)
    return [
        F.count("*").alias("rows"),
        F.sum(row_hash.cast("decimal(38,0)")).alias("hash_sum"),
        F.bit_xor(row_hash).alias("hash_xor"),
        F.max(F.xxhash64(F.lit("|".join(columns)))).alias("schema_hash"),
    ]


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint of a table's content: one row, one pass, no shuffle of rows."""
    return df.agg(*fingerprint_aggregates(df))


def as_text(counted: dict) -> str:
    """The fingerprint as one short text."""
    parts = [counted[k] or 0 for k in ("schema_hash", "rows", "hash_sum", "hash_xor")]
    return f"{parts[0]:x}-{parts[1]}-{parts[2]}-{parts[3]:x}"


def fingerprint_text(df: DataFrame) -> str:
    return as_text(fingerprint(df).first().asDict())


def stage(df: DataFrame, root: str, name: str, run_id: str, fmt: str = "parquet", by: Sequence[str] = ()) -> str:
    """Write ``<root>/<name>/run_id=<id>``, which nobody reads before it is published; its path."""
    path = f"{root}/{name}/run_id={run_id}"
    writer = df.write.mode("errorifexists").format(fmt).options(**WRITE_OPTIONS.get(fmt, {}))
    (writer.partitionBy(*by) if by else writer).save(path)
    return path


def publish(spark: SparkSession, root: str, run_id: str, tables: Mapping[str, str]) -> None:
    """Make all staged tables of a run (name -> path) the newest ones, by one commit: readers see all or none."""
    ledger = Ledger(spark, f"{root}/{FOLDER}")
    parts = [Part(name, path) for name, path in tables.items()]
    # Numbered, so that a run may publish more than once; a repeated call adds nothing.
    digest = settings_digest(sorted(tables.items()))
    ledger.once(f"{run_id}/{digest}", 0, lambda commits: parts)


def write_versioned(
    df: DataFrame, root: str, name: str, run_id: str, fmt: str = "parquet"
) -> str:
    """Stage one table and publish it."""
    path = stage(df, root, name, run_id, fmt)
    publish(df.sparkSession, root, run_id, {name: path})
    return path


def published_tables(spark: SparkSession, root: str, run_id: str | None = None) -> dict[str, str]:
    """Paths by name of what one run has published, the newest or the named one. Tables of one run belong together."""
    commits = Ledger(spark, f"{root}/{FOLDER}").commits()
    newest = run_id or (commits[-1].writer.partition("/")[0] if commits else None)
    return {p.table: p.path for c in commits if c.writer.partition("/")[0] == newest for p in c.parts}


def latest_version(spark: SparkSession, root: str, name: str) -> tuple[str, str] | None:
    """(run id, path) of the newest published version, or None when nothing was published yet."""
    for commit in reversed(Ledger(spark, f"{root}/{FOLDER}").commits()):
        for part in commit.parts:
            if part.table == name:
                return commit.writer.partition("/")[0], part.path
    return None


def read_latest(
    spark: SparkSession, root: str, name: str, fmt: str = "parquet", schema: str | None = None
) -> DataFrame:
    """The newest version; text formats need a schema."""
    found = latest_version(spark, root, name)
    if found is None:
        raise FileNotFoundError(f"no version of {name!r} below {root}")
    reader = spark.read.format(fmt).options(**WRITE_OPTIONS.get(fmt, {}))
    return (reader.schema(schema) if schema else reader).load(found[1])


def run_record(
    spark: SparkSession,
    *,
    run_id: str,
    code_version: str,
    pipeline_version: str,
    input_source: str,
    input_fingerprint: str,
    data_through: str,
    rows_in: int,
    rows_clean: int,
    months: int,
    settings: str = "",
    evaluated: DataFrame | None = None,
    streams: Sequence[str] = (),
) -> DataFrame:
    """One row describing a run, with selections and metrics of the named ``streams`` as maps.

    The maps hold the named streams only, so the row stays small however many series were
    evaluated; all of them are in the run's evaluation table.
    """
    facts = spark.createDataFrame(
        [
            (
                SCHEMA_VERSION, run_id, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
                code_version, pipeline_version, input_source, input_fingerprint, data_through,
                rows_in, rows_clean, months, settings,
            )
        ],
        "schema_version int, run_id string, run_at string, code_version string, "
        "pipeline_version string, input_source string, input_fingerprint string, "
        "data_through string, rows_in bigint, rows_clean bigint, months int, settings_digest string",
    )
    if evaluated is None:
        empty = lambda kind: F.lit(None).cast(kind)
        return facts.withColumn("model_selections", empty("map<string,string>")).withColumn(
            "metrics",
            empty(
                "map<string,struct<mase:double,rmse:double,winkler80:double,"
                "ljung_box_p:double,beats_baseline:boolean>>"
            ),
        )
    p_value = (
        F.col("ljung_box_p") if "ljung_box_p" in evaluated.columns else F.lit(None).cast("double")
    )
    metrics = F.struct(
        "mase", "rmse", "winkler80", p_value.alias("ljung_box_p"), "beats_baseline"
    )
    maps = evaluated.filter(F.col("series_id").isin(*streams)).agg(
        F.map_from_entries(F.collect_list(F.struct("series_id", "model"))).alias("model_selections"),
        F.map_from_entries(F.collect_list(F.struct(F.col("series_id"), metrics))).alias("metrics"),
    )
    return facts.withColumn(
        "model_selections", maps.select("model_selections").scalar()
    ).withColumn("metrics", maps.select("metrics").scalar())


def append_run(record: DataFrame, path: str) -> None:
    """Add a run to the log; earlier runs are never rewritten."""
    record.coalesce(1).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """The run log, or None when it does not exist. Any other failure is raised, so that a gate
    cannot mistake an unreadable log for a first run."""
    if not path_exists(spark, path):
        return None
    return spark.read.schema(RUN_SCHEMA).option("mode", "FAILFAST").json(path)


def last_run(spark: SparkSession, path: str) -> dict | None:
    """The newest run as a dict, or None before the first one."""
    runs = read_runs(spark, path)
    if runs is None:
        return None
    newest = runs.agg(
        F.max_by(F.to_json(F.struct("*")), F.struct("run_at", "run_id")).alias("run")
    ).first()["run"]
    return json.loads(newest) if newest else None


def prior_mase(spark: SparkSession, log: str, root: str, name: str = "evaluation") -> DataFrame | None:
    """(series_id, prior_mase) of the newest logged run for the regression gate, or None.

    Read from that run's evaluation table, a row per series. A logged run without its table is
    an error, not a first run.
    """
    newest = last_run(spark, log)
    if newest is None:
        return None
    table = spark.read.parquet(f"{root}/{name}/run_id={newest['run_id']}")
    return table.select("series_id", F.col("mase").alias("prior_mase"))


def settings_digest(*parts) -> str:
    """A short digest of everything a run was asked for."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


def unchanged(prior: dict | None, input_fingerprint: str, code_version: str, settings: str = "") -> bool:
    """Whether a run can be skipped: same input, code and settings as the newest one."""
    return (
        prior is not None
        and prior.get("input_fingerprint") == input_fingerprint
        and prior.get("code_version") == code_version
        and (prior.get("settings_digest") or "") == settings
    )


class StaleModelError(RuntimeError):
    """Raised when models were fitted on other data than the present input."""


def require_fresh(fitted_on: str | None, input_fingerprint: str) -> None:
    """Refuse models whose recorded input differs from the present one."""
    if fitted_on and fitted_on != input_fingerprint:
        raise StaleModelError(
            f"models were fitted on {fitted_on}, the input is {input_fingerprint}: fit again"
        )


def require_version(resolved: DataFrame, wanted: str, contract: str) -> DataFrame:
    """The resolved versions, or an error that says what to register."""
    if wanted.isdigit() and int(wanted) < 1:
        raise ValueError("a pinned version must be a positive number")
    if resolved.isEmpty():
        raise LookupError(f"no version for {wanted!r} with contract {contract!r}: register one first")
    return resolved


def resolve_versions(
    versions: DataFrame, wanted: Column, contract: str, model: str = "model"
) -> DataFrame:
    """One version per model for a request: a number pins it, 'latest' takes the highest version
    that carries ``contract``, any other text is an alias.

    ``versions(model, version, contract, alias, run_id)``. A pinned number is taken as asked.
    """
    is_latest = F.lower(wanted) == "latest"
    is_number = wanted.rlike("^[0-9]+$")
    fits = (
        F.when(is_number, F.col("version") == wanted.try_cast("int"))
        .when(is_latest, F.col("contract") == contract)
        .otherwise(F.col("alias") == wanted)
    )
    return (
        versions.filter(fits)
        .groupBy(model)
        .agg(
            F.max("version").alias("version"),
            F.max_by("run_id", "version").alias("run_id"),
        )
    )


def resolve_requests(versions: DataFrame, requests: DataFrame, contract: str, model: str = "model") -> DataFrame:
    """Versions for a whole table of requests: request, model, version, run_id, by the rules of :func:`resolve_versions`.

    A version answers up to three keys: its number, its alias, and 'latest' where it carries ``contract``. The
    highest version of every model and key is found first, in one pass with partial aggregation; requests then meet
    these by equality. ``requests(request[, model])``: without a model a request is answered for all. Equal requests are
    one; a request without an answer has no row.
    """
    number = F.struct(F.lit("number").alias("kind"), F.col("version").cast("string").alias("key"))
    alias = F.when(F.col("alias").isNotNull(), F.struct(F.lit("alias").alias("kind"), F.col("alias").alias("key")))
    fits = F.when(F.col("contract") == contract, F.struct(F.lit("latest").alias("kind"), F.lit("").alias("key")))
    answers = (
        versions.select(model, "version", "run_id", F.inline(F.array_compact(F.array(number, alias, fits))))
        .groupBy(model, "kind", "key")
        .agg(F.max("version").alias("version"), F.max_by("run_id", "version").alias("run_id"))
    )
    wanted = F.col("request")
    is_number, is_latest = wanted.rlike("^[0-9]+$"), F.lower(wanted) == "latest"
    keyed = requests.distinct().withColumns(
        {
            "kind": F.when(is_number, "number").when(is_latest, "latest").otherwise("alias"),
            "key": F.when(is_number, wanted.try_cast("int").cast("string")).when(is_latest, "").otherwise(wanted),
        }
    )
    on = ["kind", "key", model] if model in requests.columns else ["kind", "key"]
    return keyed.join(answers, on).select("request", model, "version", "run_id")
