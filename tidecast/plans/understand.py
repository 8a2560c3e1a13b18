"""One export batch understood: dates, columns, groups, panel, states and violations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.operators import columns as C
from tidecast.operators import dates as D
from tidecast.operators import panel as P
from tidecast.operators import quality as Q
from tidecast.session import landed, landed_together


@dataclass
class Batch:
    """Lazy frames of a batch; every one covers all of its sources."""

    headers: DataFrame
    rows: DataFrame
    per_day: DataFrame
    stats: DataFrame
    columns: DataFrame
    groups: DataFrame
    labels: DataFrame
    currencies: DataFrame
    keyed: DataFrame
    panel: DataFrame
    states: DataFrame
    violations: DataFrame


def understand(
    records: DataFrame,
    headers: DataFrame,
    shape: list[DataFrame] | None = None,
    group_by: str | None = None,
    wanted: list[str] | None = None,
    fill_absent: bool = False,
    min_days: int = fixed.MIN_DAYS,
    land: bool = False,
) -> Batch:
    """Infer and check every source of a batch.

    ``records``: source, row_num, cells. With ``land``, dated rows and column metadata
    are written once to the shared folder, since many passes read them.
    """
    order = D.date_order(records)
    if land:
        order = landed(order, "order")
    dated = D.dated_rows(records, order)
    if land:
        dated = landed(dated, "rows")
    rules = list(shape or [])
    rules += [Q.undecided_dates(order), Q.unreadable_dates(dated, headers)]
    rows = dated.where("day is not null")

    stopped = None
    if fill_absent:
        raw_stats = D.day_stats(D.rows_per_day(rows))
        first_look = C.classify(
            C.name_columns(C.column_profile(rows), headers), raw_stats, wanted
        )
        if land:
            first_look, raw_stats = landed_together(first_look=first_look, raw_stats=raw_stats)
        marks = C.per_day_label(first_look, C.label_stats(rows, first_look), group_by)
        if land:
            marks = landed(marks, "marks")
        spans = P.entity_spans(rows, marks)
        rules += [
            Q.no_fill_label(raw_stats, marks),
            Q.holes(P.interior_holes(spans, raw_stats)),
        ]
        stopped = P.stopped_entities(spans, raw_stats)
        rows = P.fill_absent(rows, spans, raw_stats, first_look, order)
        if land:
            rows = landed(rows, "filled")
            stopped = landed(stopped, "stopped")

    per_day = D.rows_per_day(rows)
    stats = D.day_stats(per_day)
    named = C.name_columns(C.column_profile(rows), headers)
    if land:
        stats, named = landed_together(stats=stats, profile=named)
    columns = C.choose_weights(C.classify(named, stats, wanted))
    if land:
        columns = landed(columns, "columns")
    labels_found = C.label_stats(rows, columns)
    if land:
        labels_found = landed(labels_found, "labels")
    groups = C.group_columns(columns, labels_found, stats, group_by)
    if land:
        groups = landed(groups, "groups")
    labels = C.entity_labels(rows, columns, groups)
    if land:
        labels = landed(labels, "entity_labels")
    currencies = C.currency_columns(rows, columns)
    status = C.status_columns(columns)
    keyed = P.with_status(P.keyed_rows(rows, groups, labels), status)
    if land:
        # From here on only the panel reads cells; the rules read narrow columns.
        keyed = landed(keyed, "keyed")
    panel = P.build_panel(keyed, columns)
    # Columns stand in the order of the file, those asked for by name in the order of asking.
    columns = columns.withColumn("position", F.col("col_idx").cast("int"))
    if wanted:
        asked = [w.strip().lower() for w in wanted]
        place = F.array_position(F.array(*[F.lit(a) for a in asked]), F.lower("name")).cast("int")
        columns = columns.withColumn("position", F.when(place > 0, place - 1).otherwise(
            F.col("position") + len(asked)))
        columns = columns.withColumn(
            "role",
            F.when(
                (F.col("role") == "metric") & ~F.lower("name").isin(asked), F.lit("not_metric")
            ).otherwise(F.col("role")),
        )
    if land:
        panel = landed(panel, "panel")
    stopped_names = None
    if stopped is not None:
        renamed = stopped.join(
            labels.select("source", F.col("key").alias("entity"), "label"),
            ["source", "entity"],
            "left",
        )
        stopped_names = renamed.select("source", F.coalesce("label", "entity").alias("entity"))
    states = P.entity_states(
        panel, columns, P.running_entities(keyed, stats), status, stopped_names
    )
    rules += [
        Q.uneven_days(per_day, stats),
        Q.bad_cells(named),
        Q.column_rules(columns, currencies),
        Q.group_rules(groups, rows, columns, stats),
        Q.named_account(keyed),
        Q.same_entities(Q.entity_days(keyed), stats),
        Q.overflow(panel),
        Q.calendar(per_day, stats, min_days),
    ]
    if wanted:
        rules.append(Q.requested_columns(columns, wanted))
    violations = Q.union_all(rules)
    if land:
        violations = landed(violations, "violations")
    return Batch(
        headers, rows, per_day, stats, columns, groups, labels, currencies, keyed, panel,
        states, violations,
    )
