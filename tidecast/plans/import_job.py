"""The recurring job: exports in, forecasts and history stored, violations reported.

Everything is computed and checked before anything stored is touched. What the later
steps read is first written to the shared folder, so that a lost executor costs a
task. Tables change together, by one version of the store: a job that fails anywhere
leaves it as it was and can be repeated.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.operators import forecast as M
from tidecast.operators import panel as P
from tidecast.operators import quality as Q
from tidecast.operators import records as R
from tidecast.plans.understand import Batch, understand
from tidecast.session import landed, landed_together, together
from tidecast.sources import exports, ledger
from tidecast.sources.store import (
    Change,
    Store,
    identified,
    make_run_entities,
    make_runs,
    stored_forecasts,
)

DEFAULT_MODELS = ["seasonal_naive", "weekday_quantile", "trend_weekday"]


@dataclass
class Imported:
    violations: DataFrame
    flight: DataFrame
    runs: DataFrame
    batch: Batch
    history: DataFrame


def read_batch(
    lines: DataFrame,
    land: bool = True,
    max_columns: int | None = None,
    max_cell_bytes: int | None = None,
    **options,
) -> Batch:
    """Lines of any number of exports, understood.

    ``max_columns`` and ``max_cell_bytes`` refuse exports past a size; by default none is.
    """
    summary = R.block_summary(lines)
    if land:
        summary = landed(summary, "blocks")
    parsed = R.parse_records(R.to_records(lines, summary), max_columns, max_cell_bytes)
    if land:
        parsed = landed(parsed, "records")
    magic = exports.magic_kinds(parsed)
    suspects = parsed.where("width < 2").select("source").distinct()
    if land:
        suspects = landed(suspects, "suspects")
    separated = exports.other_separators(lines, suspects.join(magic, "source", "left_anti"))
    shape = [Q.not_a_csv(magic), Q.not_a_csv(separated), Q.file_shape(parsed)]
    headers = R.headers_of(parsed)
    # A source that is no CSV, or has broken records, says nothing worth reading on.
    if land:
        found, headers = landed_together(shape=Q.union_all(shape), headers=headers)
        shape = [found]
    broken = Q.union_all(shape).select("source").distinct()
    records = R.data_rows(parsed).join(broken, "source", "left_anti")
    return understand(records, headers, shape, land=land, **options)


def forecast_batch(
    batch: Batch,
    horizon: int,
    models: list[str] | None = None,
    fitted: bool = False,
    min_days: int = fixed.IMPORT_MIN_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """Every model on every window a source can fill, repaired, plus their average.

    Returns the flight and the histories it was made from.
    """
    Q.check_horizon(horizon)
    good = Q.accepted(batch.stats, batch.violations).where(F.col("n_days") >= min_days)
    plan = P.window_plan(good)
    inputs = P.forecast_input(batch.panel, batch.columns, batch.states)
    # One exchange by series; every forecaster starts from it.
    history = M.history_of(inputs, plan).repartition(*M.KEYS)
    flights = [M.NATIVE[name](history, horizon) for name in models or DEFAULT_MODELS]
    plain = Q.union_all(flights)
    if fitted:
        plain = plain.unionByName(
            M.pooled_ridge(history.where("window = 'full'"), horizon)
        )
    ready = landed(M.floored(M.repaired(plain)), "flight")
    average = M.average_runs(M.averaged_members(ready, M.FITTED))
    average = average.withColumns({"crossing": F.lit(0.0), "clamped": F.lit(0)})
    return ready.unionByName(average.drop("n_runs")), history


def average_info(models: list[str]) -> dict[str, str]:
    """What an averaged run says of itself: its members and their common grid."""
    average = {
        "model": fixed.AVERAGE_LABEL,
        "averaged": [f"{m}@{fixed.AVERAGE_WINDOW}" for m in models],
        "quantiles": fixed.GRID,
    }
    return {"average": json.dumps(average)}


def import_lines(
    lines: DataFrame,
    store: Store,
    horizon: int = 7,
    fill_absent: bool = False,
    fresh: bool = False,
    models: list[str] | None = None,
    fitted: bool = False,
    keep_runs: bool = True,
    files: DataFrame | None = None,
    **limits,
) -> Imported:
    """Import a batch: understand, forecast, check, and only then publish what is new.

    A source with an unusable forecast is refused like one with unusable rows; the others
    are stored. ``fresh`` empties the store first, as the first batch of a new account does.
    ``files`` are the ledger's rows of what is read here; those of sources that were stored
    are recorded with them. ``limits`` are those of ``read_batch``.
    """
    Q.check_horizon(horizon)
    batch = read_batch(
        lines, fill_absent=fill_absent, min_days=fixed.IMPORT_MIN_DAYS, **limits
    )
    names = models or DEFAULT_MODELS
    flight, history = forecast_batch(batch, horizon, names, fitted)
    flight = landed(flight, "flight")
    unusable = Q.unusable_forecasts(M.contract_violations(flight, horizon))
    violations, runs = landed_together(
        violations=batch.violations.unionByName(unusable),
        runs=make_runs(
            flight, M.series_hash(history), batch.groups, horizon, average_info(names)
        ),
    )
    refused = violations.select(F.col("source").alias("series_id")).distinct()
    flight = flight.join(refused, "series_id", "left_anti")
    runs = runs.join(refused, "series_id", "left_anti")
    flight = identified(flight, runs)

    with store.change() as change:
        if fresh:
            change.clear()
        save_batch(change, batch, violations)
        if keep_runs:
            entities = make_run_entities(flight, P.entity_positions(batch.keyed))
            change.append_runs(runs, entities, stored_forecasts(flight))
            if fitted:
                change.append_models(history.where("window = 'full'"), "pooled_ridge",
                                     M.ridge_settings())
        if files is not None:
            change.append("files", Q.accepted(files, violations))
    return Imported(violations, flight, runs, batch, history)


def save_batch(change: Change, batch: Batch, violations: DataFrame) -> None:
    """Datasets of the sources without a violation, also where nothing of one is left."""
    keys = landed(Q.accepted(batch.stats, violations).select("source").distinct(), "datasets")
    together(
        lambda: change.save_series(Q.accepted(batch.panel, violations), keys),
        lambda: change.save_raw(Q.accepted(batch.rows, violations), batch.headers, keys),
        lambda: change.save_columns(Q.accepted(batch.columns, violations), keys),
    )


def import_folder(
    spark: SparkSession, folder: str, store: Store, archive: str | None = None, **options
) -> Imported | None:
    """Import the files of a folder that are new or changed; None if none is.

    What was read is in the store's ledger, published with the data that came of it. A file
    that was refused is not in it and is read again the next time. ``archive`` is a folder
    that imported files are moved to, none over another; a move that failed is made up for
    by the next import. ``fresh`` reads every file.
    """
    new = ledger.pending(spark, folder, store, everything=options.get("fresh", False))
    done = None
    if not new.isEmpty():
        lines = exports.read_lines(spark, ledger.paths(new))
        files, changed = ledger.recorded(new, lines, store)
        if changed.isEmpty():
            with store.change() as change:
                change.append("files", files)
        else:
            lines = lines.join(changed, "source", "left_semi")
            done = import_lines(lines, store, files=files, **options)
    if archive:
        ledger.archive(spark, folder, store, archive)
    return done
