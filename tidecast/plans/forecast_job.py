"""One model over a batch of exports, added to what is stored.

Unlike the import this never empties the store: runs accumulate, and the next export
brings the actuals they are scored against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.operators import forecast as M
from tidecast.operators import panel as P
from tidecast.operators import quality as Q
from tidecast.plans.import_job import Imported, read_batch, save_batch
from tidecast.plans.understand import Batch
from tidecast.session import landed, landed_together
from tidecast.sources.store import (
    Store,
    identified,
    make_run_entities,
    make_runs,
    stored_forecasts,
)


def future_frame(stats: DataFrame, given: dict[str, list[float]], horizon: int) -> DataFrame:
    """``source, metric, step, value``: the same known values for every source."""
    for name, values in given.items():
        if len(values) != horizon:
            raise ValueError(f"{name} has {len(values)} values but the horizon is {horizon}")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.lit(i + 1).alias("step"),
                F.lit(float(v)).alias("value"),
            )
            for name, values in given.items()
            for i, v in enumerate(values)
        ]
    )
    return stats.select("source", F.explode(rows).alias("f")).select("source", "f.*")


def forecast_lines(
    lines: DataFrame,
    store: Store,
    model: str | M.Forecaster = "seasonal_naive",
    horizon: int = 7,
    columns: list[str] | None = None,
    group_by: str | None = None,
    entities: list[str] | None = None,
    future: dict[str, list[float]] | None = None,
    fill_absent: bool = False,
) -> Imported:
    """Forecast with one model, native by name or a class of your own, and store the run.

    ``future`` gives columns whose coming values are known: they are inputs, no longer
    forecast, and may be settings such as a budget.
    """
    Q.check_horizon(horizon)
    future = future or {}
    name = model if isinstance(model, str) else model.name
    can = M.COVARIATES[model] if isinstance(model, str) else model.covariates
    M.require_inputs_usable(name, can, list(future))
    if name == "covariate_line" and len(future) != 1:
        raise ValueError("covariate_line needs exactly one column whose future is known")

    batch = read_batch(lines, wanted=columns, group_by=group_by, fill_absent=fill_absent)
    rules = [batch.violations]
    if entities:
        rules.append(Q.requested_entities(batch.states, entities))
    ahead = None
    if future:
        ahead = landed(future_frame(batch.stats, future, horizon), "future")
        rules.append(Q.future_inputs(batch.columns, ahead, horizon))
    violations = landed(Q.union_all(rules), "violations")

    good = Q.accepted(batch.panel, violations)
    inputs = P.forecast_input(good, batch.columns, batch.states)
    if entities:
        chosen = [fixed.ACCOUNT if e.lower() == "account" else e for e in entities]
        inputs = inputs.where(F.lower("entity").isin([e.lower() for e in chosen]))
    plan = batch.stats.select(
        "source", F.lit("full").alias("window"), F.lit(0).alias("window_days"),
        F.col("last_day").alias("as_of"),
    )
    history = landed(
        M.history_of(inputs.where(~F.col("metric").isin(list(future))), plan), "history"
    )
    flight = _fly(model, history, good, ahead, plan, list(future), horizon)
    flight = landed(M.floored(M.repaired(flight)), "flight")
    unusable, runs = landed_together(
        unusable=Q.unusable_forecasts(M.contract_violations(flight, horizon)),
        runs=make_runs(flight, M.series_hash(history), batch.groups, horizon, with_window=False),
    )
    usable, violations = violations, violations.unionByName(unusable)
    refused = unusable.select(F.col("source").alias("series_id")).distinct()
    flight = flight.join(refused, "series_id", "left_anti")
    runs = runs.join(refused, "series_id", "left_anti")
    flight = identified(flight, runs, with_window=False)
    with store.change() as change:
        # An unusable forecast is no fault of the data, which are stored all the same.
        save_batch(change, batch, usable)
        run_entities = make_run_entities(flight, _positions(batch, entities))
        change.append_runs(runs, run_entities, stored_forecasts(flight))
    return Imported(violations, flight, runs, batch, history)


def _positions(batch: Batch, entities: list[str] | None) -> DataFrame:
    """Where entities were asked for, the order of asking; else that of the file."""
    found = P.entity_positions(batch.keyed)
    if not entities:
        return found
    asked = F.array(*[F.lit(e.lower()) for e in entities])
    return found.withColumn("position", F.array_position(asked, F.lower("entity")))


def _fly(
    model: str | M.Forecaster,
    history: DataFrame,
    panel: DataFrame,
    ahead: DataFrame | None,
    plan: DataFrame,
    inputs: list[str],
    horizon: int,
) -> DataFrame:
    if isinstance(model, str) and model in M.NATIVE:
        return M.NATIVE[model](history, horizon)
    if model == "pooled_ridge":
        return M.pooled_ridge(history, horizon)
    if ahead is None:
        return M.with_plugin(history, model, horizon)
    # The known values are the same for every entity; their past is each entity's own.
    coming = (
        ahead.join(plan.select("source", "as_of"), "source")
        .select(
            F.col("source").alias("series_id"), "metric",
            F.date_add("as_of", F.col("step")).alias("day"), "value",
        )
        .join(history.select("series_id", "entity").distinct(), "series_id")
    )
    past = panel.where(F.col("metric").isin(inputs)).select(
        F.col("source").alias("series_id"), "entity", "metric", "day", "value"
    )
    if model == "covariate_line":
        return M.covariate_line(
            history,
            past.select("series_id", "entity", "day", F.col("value").alias("x")),
            coming.select("series_id", "entity", "day", F.col("value").alias("x")),
        )
    keys = history.select("series_id", "entity", "window", "as_of").distinct()
    seen = past.join(keys, ["series_id", "entity"]).withColumn(
        "concept", F.lit(None).cast("string")
    )
    both = history.unionByName(seen.select(*history.columns))
    return M.with_plugin(both, model, horizon, inputs, coming)
