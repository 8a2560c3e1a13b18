"""The stored tables and what may be done to them.

``raw`` (source, row_num, day, data), ``series`` (series_id, entity, metric, day, value),
``columns`` (source, name, role, ...), ``runs``, ``run_entities``, ``forecasts``, the
``models`` fitted to stored data and the ``files`` that were read, as Parquet below one root
on shared storage. Datasets are replaced whole, runs and files are appended. The entities of
a run are rows: a list of them in one cell would grow with the data.

A store has versions. A change writes its files into folders of its own and is published by
one small manifest, renamed into place, that names the folders of every table. Readers see
the manifest they opened and nothing else, so a change is there whole or not at all, and a
job that died can be repeated. Datasets lie in hash buckets: replacing some rewrites the
buckets they are in, however many accounts the store has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast import fixed
from tidecast.functions import names as N
from tidecast.functions.cells import trimmed
from tidecast.functions.text import run_label
from tidecast.operators.accuracy import accuracy_view
from tidecast.operators.forecast import COVARIATES, FITTED, long_form
from tidecast.session import landed, together
from tidecast.sources.files import Files

SCHEMAS = {
    "raw": "row_num bigint, day date, data map<string,string>, source string",
    "series": "entity string, metric string, day date, value double, series_id string",
    "columns": "name string, role string, concept string, averaged boolean, "
    "is_percent boolean, weighted_by string, position int, source string",
    "runs": "id string, series_id string, model string, horizon int, created_at timestamp, "
    "as_of date, metrics array<string>, n_entities bigint, group_by string, "
    "input_hash string, model_info string",
    "run_entities": "run_id string, series_id string, entity string, position bigint",
    "models": "model string, series_id string, trained_through date, metrics array<string>, "
    "n_rows bigint, created_at timestamp, settings string",
    "forecasts": "run_id string, entity string, metric string, day date, q_idx int, "
    "quantile double, value double",
    "files": "path string, source string, length bigint, modified timestamp, digest string, "
    "imported boolean, read_at timestamp",
}
#: What a run is: another value in any of these is another run.
RUN_IDENTITY = ["series_id", "model", "as_of", "horizon", "group_by", "metrics", "n_entities",
                "input_hash"]
#: Tables that hold datasets, and the column that names a row's dataset.
DATASET = {"raw": "source", "series": "series_id", "columns": "source"}
BUCKETS = 64


class StaleStore(RuntimeError):
    """Another change was published since this one began; it can be made again."""


class Store:
    """A store at its newest version or, from ``at``, at a given one."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = Files(spark)
        self._version = version

    def create(self, buckets: int = BUCKETS) -> Store:
        """Make the store exist, every table empty, unless it does already."""
        if not self.versions():
            self._publish(0, {"buckets": buckets, "tables": {t: [] for t in SCHEMAS}})
        return self

    # -- versions ------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = self.files.names(f"{self.root}/versions")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        if self._version is not None:
            return self._version
        found = self.versions()
        if not found:
            raise ValueError(f"there is no store in {self.root}")
        return found[-1]

    def at(self, version: int) -> Store:
        """The store as that version left it, for reading."""
        return Store(self.spark, self.root, version)

    def manifest(self) -> dict:
        return json.loads(self.files.text(self._manifest_path(self.version())))

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}.json"

    def _publish(self, version: int, manifest: dict) -> None:
        if not self.files.publish(self._manifest_path(version), json.dumps(manifest)):
            raise StaleStore(f"version {version} of {self.root} was published by another job")

    def read(self, table: str) -> DataFrame:
        return self._read(table, self.manifest()["tables"][table])

    def _read(self, table: str, folders: list[str]) -> DataFrame:
        """The rows in some of a table's folders, named below the table's own."""
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        top = f"{self.root}/{table}"
        schema = SCHEMAS[table]
        return self.spark.read.schema(schema).parquet(*[f"{top}/{x}" for x in folders])

    @contextmanager
    def change(self) -> Iterator[Change]:
        """What is done to the change is published together when the block ends well."""
        if self._version is not None:
            raise ValueError("only the newest version of a store can be changed")
        change = Change(self)
        yield change
        self._publish(change.base + 1, change.manifest)

    def sweep(self, keep: int = 2) -> None:
        """Forget all but the newest versions, and delete the folders only older ones name.

        Folders that no manifest names, of a change under way or a failed one, are left.
        """
        found = self.versions()
        old, kept = found[:-keep], found[-keep:]
        used = {(t, x) for v in kept for t, xs in self.at(v).manifest()["tables"].items() for x in xs}
        for v in old:
            for t, xs in self.at(v).manifest()["tables"].items():
                for x in xs:
                    if (t, x) not in used:
                        self.files.delete(f"{self.root}/{t}/{x}")
            self.files.delete(self._manifest_path(v))

    # -- changes of one step -------------------------------------------------------------

    def save_raw(self, rows: DataFrame, headers: DataFrame, keys: DataFrame | None = None):
        with self.change() as c:
            c.save_raw(rows, headers, keys)

    def save_series(self, panel: DataFrame, keys: DataFrame | None = None):
        with self.change() as c:
            c.save_series(panel, keys)

    def save_columns(self, columns: DataFrame, keys: DataFrame | None = None):
        with self.change() as c:
            c.save_columns(columns, keys)

    def append_runs(self, runs: DataFrame, run_entities: DataFrame, forecasts: DataFrame) -> None:
        with self.change() as c:
            c.append_runs(runs, run_entities, forecasts)

    def append_models(self, history: DataFrame, model: str, settings: dict | None = None) -> None:
        with self.change() as c:
            c.append_models(history, model, settings)

    def clear(self) -> None:
        """Empty every table; older versions still read."""
        with self.change() as c:
            c.clear()

    def accuracy_view(self, name: str = "forecast_accuracy") -> DataFrame:
        """Forecasts against actuals as a temporary view; nothing is copied."""
        view = accuracy_view(self.read("forecasts"), self.read("runs"), self.read("series"))
        view.createOrReplaceTempView(name)
        return view

    def run_list(self) -> DataFrame:
        return self.read("runs").select(
            "id", "series_id", "model", "horizon", "created_at",
            F.get_json_object("model_info", "$.weights_sha256").alias("weights"),
        ).orderBy(F.desc("created_at"))

    def series_of(self, series_id: str, entity: str, metric: str) -> DataFrame:
        return (
            self.read("series")
            .where(
                (F.col("series_id") == series_id)
                & (F.col("entity") == entity)
                & (F.col("metric") == metric)
            )
            .select("day", "value")
            .orderBy("day")
        )

    def datasets(self, want: str | None = None) -> DataFrame:
        """Datasets that have forecasts, or the one asked for whatever its case."""
        names = self.read("runs").select("series_id").distinct()
        if want is not None:
            names = names.where(F.lower("series_id") == want.lower())
        return names.orderBy("series_id")


class Change:
    """Tables as they will be: written now, seen by readers only once they are published."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.base = store.version()
        self.manifest = store.at(self.base).manifest()
        self.name, self.steps = uuid.uuid4().hex, count(1)

    def read(self, table: str) -> DataFrame:
        return self.store._read(table, self.manifest["tables"][table])

    def clear(self) -> None:
        self.manifest["tables"] = {t: [] for t in SCHEMAS}

    def _folder(self) -> str:
        return f"v={self.name}-{next(self.steps)}"

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.manifest["buckets"])).cast("int")

    def replace(self, table: str, df: DataFrame, keys: DataFrame | None = None) -> None:
        """Datasets in ``df`` and those named by ``keys`` have the rows of ``df`` from now on.

        ``keys``, where given, has the name of every such dataset in its first column: one
        that came back empty has no row to say so. Only the buckets that hold these datasets are written anew. A bucket
        too large for one task is split, so the largest dataset is neither one file nor one
        task.
        """
        key = DATASET[table]
        if keys is None:
            named = landed(df.select(key).distinct(), "datasets")
        else:
            named = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
        buckets = [r[0] for r in named.select(self._bucket(key)).distinct().collect()]
        names = tuple(f"/bucket={b}" for b in buckets)
        have = self.manifest["tables"][table]
        touched = [x for x in have if x.endswith(names)] if names else []
        rows = _shaped(table, df)
        if touched:
            rows = rows.unionByName(self.store._read(table, touched).join(named, key, "left_anti"))
        folder = self._folder()
        (
            rows.withColumn("bucket", self._bucket(key))
            .hint("rebalance", F.col("bucket"))
            .write.partitionBy("bucket")
            .parquet(f"{self.store.root}/{table}/{folder}")
        )
        made = self.store.files.names(f"{self.store.root}/{table}/{folder}")
        made = [f"{folder}/{n}" for n in sorted(made) if n.startswith("bucket=")]
        self.manifest["tables"][table] = [x for x in have if x not in touched] + made

    def append(self, table: str, df: DataFrame) -> None:
        folder = self._folder()
        _shaped(table, df).write.parquet(f"{self.store.root}/{table}/{folder}")
        self.manifest["tables"][table].append(folder)

    def save_raw(self, rows: DataFrame, headers: DataFrame, keys: DataFrame | None = None):
        self.replace("raw", raw_rows(rows, headers), keys)

    def save_series(self, panel: DataFrame, keys: DataFrame | None = None):
        self.replace("series", panel.withColumnRenamed("source", "series_id"), keys)

    def save_columns(self, columns: DataFrame, keys: DataFrame | None = None):
        self.replace("columns", columns, keys)

    def append_runs(self, runs: DataFrame, run_entities: DataFrame, forecasts: DataFrame) -> None:
        """Store finished runs. A run must hold a forecast for each of its entities.

        A run that is stored already is left as it is. Forecasts become visible together with
        their run, so a job that fails half-way and is repeated stores each of them once.
        """
        pairs = forecasts.select("run_id", "entity").distinct()
        lacking = run_entities.join(pairs, ["run_id", "entity"], "left_anti").limit(1).collect()
        if lacking:
            raise ValueError(
                f"run {lacking[0]['run_id']} lacks a forecast for {lacking[0]['entity']!r}"
            )
        seen = self.read("runs").select("id")
        runs = landed(runs.join(seen, "id", "left_anti"), "new_runs")
        ids = runs.select(F.col("id").alias("run_id"))
        ordered = (
            forecasts.join(ids, "run_id", "left_semi")
            .repartitionByRange("entity", "metric", "quantile", "run_id", "day")
            .sortWithinPartitions("entity", "metric", "quantile")
        )
        known = run_entities.join(ids, "run_id", "left_semi")
        together(lambda: self.append("forecasts", ordered),
                 lambda: self.append("run_entities", known), lambda: self.append("runs", runs))

    def append_models(self, history: DataFrame, model: str, settings: dict | None = None) -> None:
        """Record what a fitted model has seen, per series: last day, metrics, rows, and how it
        was fitted, as JSON."""
        text = json.dumps(settings, sort_keys=True) if settings is not None else None
        seen = history.groupBy("series_id").agg(
            F.max("day").alias("trained_through"),
            F.array_sort(F.collect_set("metric")).alias("metrics"),
            F.count(F.lit(1)).alias("n_rows"),
        ).withColumns({"model": F.lit(model), "created_at": F.current_timestamp(),
                       "settings": F.lit(text).cast("string")})
        self.append("models", seen)


def _shaped(table: str, df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in T._parse_datatype_string(SCHEMAS[table]).fields])


def raw_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Input rows as they came, keyed by column name. Rows that were filled in are not
    input and never stored here."""
    # The names of a full row, and which of several equal ones is the last, are worked out
    # once for its source.
    known = headers.select("source", "header", _names("header").alias("names")).withColumn(
        "kept", _last_of_name(F.col("names"))
    )
    named = rows.where(~F.col("filled")).join(known, "source", "left")
    values = F.transform("cells", lambda c: trimmed(c)).alias("v")
    own = _names("cells")
    marked = F.arrays_zip(own.alias("k"), values, _last_of_name(own).alias("kept"))
    # Names made from positions only, as of a source without a header, are all different.
    picked = (
        F.when(F.col("header").isNull(), F.arrays_zip(own.alias("k"), values))
        .when(
            F.size("cells") == F.size("names"),
            F.filter(F.arrays_zip(F.col("names").alias("k"), values),
                     lambda _, i: F.get("kept", i)),
        )
        .otherwise(F.transform(F.filter(marked, lambda p: p["kept"]),
                               lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))
    )
    return named.select(
        "source", "row_num", "day", F.map_from_entries(picked).alias("data")
    )


def _names(of: str) -> Column:
    """The column name at each position of an array, by the header or the position."""
    return F.transform(of, lambda _, i: N.column_name(F.get("header", i), i))


def _last_of_name(names: Column) -> Column:
    """Of each position, whether no later one has the same name."""
    return F.transform(
        names, lambda n, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), n)
    )


def make_runs(
    flight: DataFrame,
    hashes: DataFrame,
    groups: DataFrame,
    horizon: int,
    infos: dict[str, str] | None = None,
    with_window: bool = True,
) -> DataFrame:
    """One ``runs`` row per (series, model, window), with what explains it.

    The id is derived from all that makes the run what it is, the numbers it was forecast
    from included: the same job again gives the same id, a revised export another one.
    """
    label = run_label(F.col("model"), F.col("window")) if with_window else F.col("model")
    infos = infos or {}
    can = F.col("model").isin([m for m, yes in COVARIATES.items() if yes])
    # NULL fields are left out of the document, so only fitted models carry a cut-off.
    fitted = F.col("model").isin(FITTED)
    info = F.to_json(
        F.struct(
            "model",
            can.alias("covariates"),
            F.when(fitted, F.col("as_of").cast("string")).alias("trained_through"),
            F.when(fitted, F.col("series_id")).alias("trained_on"),
        )
    )
    for name, text in infos.items():
        info = F.when(F.col("model") == name, F.lit(text)).otherwise(info)
    # Distinct pairs first, so that a run of any size is counted, never gathered.
    pairs = flight.select("series_id", "model", "window", "as_of", "entity", "metric").distinct()
    keys = ["series_id", "model", "window", "as_of"]
    metrics = pairs.select(*keys, "metric").distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("metric")).alias("metrics")
    )
    counts = pairs.select(*keys, "entity").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_entities")
    )
    found = metrics.join(counts, keys)
    per = found.join(hashes, ["series_id", "window"], "left").join(
        groups.select(F.col("source").alias("series_id"), "group_by"), "series_id", "left"
    )
    named = per.withColumn("model_info", info).withColumns(
        {"model": label, "group_by": F.coalesce("group_by", F.lit("")), "horizon": F.lit(horizon)}
    )
    return named.select(
        run_id(*RUN_IDENTITY).alias("id"),
        "series_id",
        "model",
        "horizon",
        F.current_timestamp().alias("created_at"),
        "as_of",
        "metrics",
        "n_entities",
        "group_by",
        "input_hash",
        "model_info",
    )


def run_id(*parts):
    """A short name for the given columns, written out so that no two can be confused."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16)


def identified(flight: DataFrame, runs: DataFrame, with_window: bool = True) -> DataFrame:
    """The flight with the ``run_id`` of the run each row belongs to."""
    label = run_label(F.col("model"), F.col("window")) if with_window else F.col("model")
    ids = runs.select(
        F.col("id").alias("run_id"), "series_id", F.col("model").alias("label"), "as_of"
    )
    return flight.withColumn("label", label).join(ids, ["series_id", "label", "as_of"]).drop(
        "label"
    )


def make_run_entities(flight: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Of a flight with run ids, the entities of each run and where each was first seen.

    ``positions``: source, entity, position. The account comes before all; without positions
    the others have none.
    """
    found = flight.select("run_id", "series_id", "entity").distinct()
    place = F.lit(None).cast("bigint")
    if positions is not None:
        seen = positions.select(F.col("source").alias("series_id"), "entity", "position")
        found, place = found.join(seen, ["series_id", "entity"], "left"), F.col("position")
    account = F.col("entity") == fixed.ACCOUNT
    return found.select("run_id", "series_id", "entity",
                        F.when(account, F.lit(0).cast("bigint")).otherwise(place).alias("position"))


def stored_forecasts(flight: DataFrame) -> DataFrame:
    """Of a flight with run ids, its rows as stored."""
    return long_form(flight).select(
        "run_id", "entity", "metric", "day", F.col("q_idx").cast("int").alias("q_idx"),
        "quantile", "value",
    )
