"""Working out what every column of every source is, from its cells and its name.

Cells stay an array on their row. A profile explodes them next to a partial aggregate,
so only one small row per (source, column) and task crosses the network.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.functions import names as N
from tidecast.functions.cells import trimmed, with_numbers
from tidecast.session import landed


# Days since 1970 and a record number share one long: room for 17 million million records.
_ROW_BITS = 44


def file_position(day: Column, row_num: Column) -> Column:
    """Order by day, then by place in the file, as one number."""
    return F.shiftleft(F.unix_date(day).cast("long"), _ROW_BITS) + row_num + 1


def row_at(position: Column) -> Column:
    return F.pmod(position, F.lit(1 << _ROW_BITS)) - 1


def column_profile(rows: DataFrame) -> DataFrame:
    """One row per (source, column): how many cells are not numbers, and what they say."""
    cells = rows.select(
        "source", "row_num", "day", "filled", F.posexplode("cells").alias("col_idx", "cell")
    ).where("col_idx > 0")
    # Most cells are plain numbers, short enough to be finite; only the others are looked into.
    cells = cells.withColumn("text", trimmed(F.col("cell")))
    cells = cells.withColumn("bare", F.btrim("text", F.lit("()")))
    plain = F.col("bare").rlike(fixed.PLAIN_NUMBER) & (F.octet_length("bare") <= 300)
    cells = cells.withColumn("plain", plain)
    read = with_numbers(cells, {"v": F.when(~F.col("plain"), F.col("cell"))})

    def other(test: Column) -> Column:
        return F.when(F.col("plain"), F.lit(False)).otherwise(test)

    facts = read.select(
        "source",
        "col_idx",
        "filled",
        file_position(F.col("day"), F.col("row_num")).alias("at"),
        other(F.col("v").isNull()).alias("bad"),
        other(F.col("v_percent")).alias("percent"),
        other(F.col("text") == "").alias("blank"),
        other(F.lower("text").isin(fixed.STATES_ON + fixed.STATES_OFF)).alias("state"),
    )
    real = ~F.col("filled")
    first_bad = F.min(F.when(F.col("bad"), F.col("at")))
    # Every buffer has a fixed width, so cells are combined in a hash table as they are
    # read; a string or struct here would sort them all first.
    return facts.groupBy("source", "col_idx").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if("bad").alias("n_bad"),
        row_at(first_bad).alias("first_bad_row"),
        F.bool_or("percent").alias("is_percent"),
        F.coalesce(first_bad == F.min("at"), F.lit(False)).alias("first_is_text"),
        F.count_if("blank").alias("n_blank"),
        F.count_if(F.col("state") & real).alias("n_state"),
        F.count_if(~F.col("state") & ~F.col("blank") & real).alias("n_other"),
    )


def name_columns(profile: DataFrame, headers: DataFrame) -> DataFrame:
    """Attach each column's name; a source without a header gets positional ones."""
    header = F.when(
        F.size("header") > F.col("col_idx"), F.element_at("header", F.col("col_idx") + 1)
    )
    return profile.join(headers, "source", "left").select(
        profile["*"], N.column_name(header, F.col("col_idx")).alias("name")
    )


def classify(
    named: DataFrame, stats: DataFrame, wanted: list[str] | None = None
) -> DataFrame:
    """Assign roles: text, identifier, setting, not_metric or metric.

    The list of known metrics applies only where a source has at least one of them, and
    never when the caller names the columns it wants.
    """
    numeric = F.col("n_bad") == 0
    matched = numeric & ~N.is_identifier(F.col("name")) & ~N.is_setting(F.col("name"))
    found = named.withColumn("numeric", numeric).withColumn(
        "concept", F.when(matched, N.concept(F.col("name")))
    )
    per_source = found.groupBy("source").agg(
        F.count_if(F.col("concept").isNotNull()).alias("n_known")
    )
    use_list = (F.col("n_known") > 0) & F.lit(not wanted)
    role = (
        F.when(~F.col("numeric"), F.lit("text"))
        .when(N.is_identifier(F.col("name")), F.lit("identifier"))
        .when(N.is_setting(F.col("name")), F.lit("setting"))
        .when(use_list & F.col("concept").isNull(), F.lit("not_metric"))
        .otherwise(F.lit("metric"))
    )
    not_addable = F.col("concept").isNotNull() & ~N.is_addable(F.col("concept"))
    averaged = (
        (F.col("role") == "metric")
        & (F.col("rows_per_day") > 1)
        & (not_addable | N.is_ratio_name(F.col("name")))
    )
    return (
        found.join(per_source, "source")
        .join(stats.select("source", "rows_per_day"), "source")
        .withColumn("role", role)
        .withColumn("averaged", averaged)
        .withColumn("unfiltered", ~use_list)
        .drop("n_known")
    )


def choose_weights(columns: DataFrame) -> DataFrame:
    """Add ``weight_idx, weighted_by``: the column a rate is blended by, if there is one.

    A candidate either names what the rate is per or is a canonical column of that
    concept; the most canonical wins, then the shorter name, then file order. The
    columns of a source are at most a few hundred, so they travel as one array.
    """
    per_source = columns.where(F.col("role").isin("metric", "setting")).groupBy("source").agg(
        F.collect_list(
            F.struct(
                "col_idx", "name", "concept", "averaged", "role", N.words(F.col("name")).alias("w")
            )
        ).alias("others")
    )
    want = N.rate_denominator(F.col("name"))
    phrase = N.denominator_phrase(F.col("name"))
    rates = (
        columns.where("averaged")
        .withColumn("want", want)
        .withColumn("phrase", phrase)
        .join(per_source, "source")
    )
    usable = F.filter(
        "others",
        lambda o: (o["role"] == "metric")
        & (o["concept"] == F.col("want"))
        & ~o["averaged"]
        & (o["col_idx"] != F.col("col_idx")),
    )

    def ranked(o):
        names_it = (F.col("phrase") != "") & (
            F.instr(o["w"], F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))) > 0
        )
        rank = F.when(names_it, F.lit(-1)).otherwise(N.pattern_rank(o["w"], F.col("want")))
        return F.struct(
            rank.alias("rank"),
            F.octet_length(o["name"]).alias("len"),
            o["col_idx"].alias("col_idx"),
            o["name"].alias("name"),
        )

    best = F.array_min(
        F.filter(
            F.transform(usable, ranked),
            lambda r: r["rank"] < N.canonical_count(F.col("want")),
        )
    )
    chosen = rates.withColumn("best", best).select(
        "source",
        "col_idx",
        F.col("best")["col_idx"].alias("weight_idx"),
        F.col("best")["name"].alias("weighted_by"),
    )
    return columns.join(chosen, ["source", "col_idx"], "left")


def _said(idx: str) -> Column:
    """A row for each wanted place: ``col_idx`` and the ``value`` there, nothing else of the
    record."""
    return F.explode(
        F.transform(
            idx,
            lambda i: F.struct(
                i.alias("col_idx"), trimmed(F.element_at("cells", i + 1)).alias("value")
            ),
        )
    ).alias("said")


def label_stats(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Distinct values of the columns that could name what a row is about.

    Only text and identifier columns are looked at, and every step groups on the value
    itself, so no task sees all values of a column.
    """
    picked = columns.where("role in ('text', 'identifier')").groupBy("source").agg(
        F.collect_list("col_idx").alias("label_idx")
    )
    values = rows.join(picked, "source").select("source", "day", _said("label_idx")).select(
        "source", "day", "said.*"
    )
    per_day = values.groupBy("source", "col_idx", "day", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_value = per_day.groupBy("source", "col_idx", "value").agg(F.max("n").alias("most"))
    per_folded = per_value.groupBy("source", "col_idx", F.lower("value").alias("folded")).agg(
        F.count(F.lit(1)).alias("n"), F.max("most").alias("most")
    )
    return per_folded.groupBy("source", "col_idx").agg(
        F.sum("n").alias("n_distinct"),
        F.count(F.lit(1)).alias("n_folded"),
        (
            (F.max("most") == 1) & (F.count_if(F.col("folded") == "") == 0) & (F.sum("n") > 1)
        ).alias("unique_per_day"),
    )


def measured_distinct(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Distinct values of measured columns; only needed to word a refusal."""
    picked = columns.where("role not in ('text', 'identifier')").groupBy("source").agg(
        F.collect_list("col_idx").alias("idx")
    )
    values = rows.join(picked, "source").select("source", _said("idx")).select("source", "said.*")
    return (
        values.groupBy("source", "col_idx", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("source", "col_idx")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )


def per_day_label(columns: DataFrame, labels: DataFrame, asked: str | None = None) -> DataFrame:
    """``source, label_idx``: the leftmost column that identifies a row within its day.

    Text is preferred over an identifier.
    """
    fit = columns.join(labels, ["source", "col_idx"]).where("unique_per_day")
    if asked is not None:
        fit = fit.where(F.lower("name") == asked.lower())
    return (
        fit.groupBy("source")
        .agg(
            F.coalesce(
                F.min(F.when(F.col("first_is_text"), F.col("col_idx"))),
                F.min(F.when(N.is_identifier(F.col("name")), F.col("col_idx"))),
            ).alias("label_idx")
        )
        .where("label_idx is not null")
    )


def group_columns(
    columns: DataFrame, labels: DataFrame, stats: DataFrame, asked: str | None = None
) -> DataFrame:
    """``source, group_idx, group_by, verdict``: the column that separates a day's rows.

    ``verdict`` is ok or single, or says why there is none; ``count_by_case`` says that the
    column asked for would do if its names did not differ in capitalisation.
    """
    joined = (
        columns.select("source", "col_idx", "name", "role", "first_is_text")
        .join(labels, ["source", "col_idx"], "left")
        .join(stats.select("source", "rows_per_day"), "source")
    )
    is_label = F.col("role").isin("text", "identifier")
    fits = F.col("n_distinct") == F.col("rows_per_day")
    # Names that differ only in capitalisation are the likeliest reason for one value too many.
    by_case = (F.col("n_folded") < F.col("n_distinct")) & (
        (F.col("n_folded") == F.col("rows_per_day"))
        | (F.col("n_distinct") == F.col("rows_per_day") + 1)
    )
    pick = F.struct("col_idx", "name")

    def first_where(test):
        return F.min(F.when(test, pick))

    facts = [F.max("rows_per_day").alias("rows_per_day")]
    if asked is not None:
        hit = N.same_name(F.col("name"), F.lit(asked))
        facts += [
            first_where(hit).alias("hit"),
            F.min_by(is_label, F.when(hit, F.col("col_idx"))).alias("hit_is_label"),
            F.min_by(fits, F.when(hit, F.col("col_idx"))).alias("hit_fits"),
            F.min_by(by_case, F.when(hit, F.col("col_idx"))).alias("hit_by_case"),
        ]
        verdict = (
            F.when(F.col("rows_per_day") == 1, F.lit("one_row_per_day"))
            .when(F.col("hit").isNull(), F.lit("unknown"))
            .when(~F.col("hit_is_label"), F.lit("measured"))
            .when(~F.col("hit_fits") & F.col("hit_by_case"), F.lit("count_by_case"))
            .when(~F.col("hit_fits"), F.lit("count"))
            .otherwise(F.lit("ok"))
        )
        chosen = F.col("hit")
    else:
        unique = F.coalesce(F.col("unique_per_day"), F.lit(False))
        facts += [
            F.count_if(fits & (F.col("role") == "text")).alias("n_text"),
            F.count_if(fits & (F.col("role") == "identifier")).alias("n_ids"),
            first_where(fits & (F.col("role") == "text")).alias("text"),
            first_where(fits & (F.col("role") == "identifier")).alias("ids"),
            first_where(unique & F.col("first_is_text")).alias("per_day_text"),
            first_where(unique & N.is_identifier(F.col("name"))).alias("per_day_id"),
        ]
        chosen = (
            F.when(F.col("n_text") > 0, F.col("text"))
            .when(F.col("n_ids") > 0, F.col("ids"))
            .otherwise(F.coalesce("per_day_text", "per_day_id"))
        )
        several = (F.col("n_text") > 1) | ((F.col("n_text") == 0) & (F.col("n_ids") > 1))
        verdict = (
            F.when(F.col("rows_per_day") == 1, F.lit("single"))
            .when(several, F.lit("several"))
            .when(chosen.isNull(), F.lit("none"))
            .otherwise(F.lit("ok"))
        )
    out = joined.groupBy("source").agg(*facts).withColumn("verdict", verdict)
    ok = F.col("verdict") == "ok"
    return out.select(
        "source",
        F.when(ok, chosen["col_idx"]).alias("group_idx"),
        F.when(ok, chosen["name"]).alias("group_by"),
        "verdict",
    )


def near_duplicates(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Names of one source that differ only in capitalisation: ``source, folded, spellings``."""
    v = trimmed(F.element_at("cells", F.col("group_idx") + 1))
    names = rows.join(groups.where("group_idx is not null"), "source").select(
        "source", v.alias("name")
    )
    distinct = names.groupBy("source", "name").agg(F.lit(1).alias("one"))
    return (
        distinct.groupBy("source", F.lower("name").alias("folded"))
        .agg(F.count(F.lit(1)).alias("spellings"))
        .where("spellings > 1")
    )


def status_columns(columns: DataFrame) -> DataFrame:
    """``source, status_idx``: the leftmost text column holding only on/off words."""
    return (
        columns.where("role = 'text' and n_state > 0 and n_other = 0")
        .groupBy("source")
        .agg(F.min("col_idx").alias("status_idx"))
    )


def currency_columns(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """``source, currency_idx, currency, mixed`` from the leftmost currency text column."""
    is_currency = N.words(F.col("name")).contains(" currency ")
    found = (
        columns.where(is_currency & (F.col("role") == "text"))
        .groupBy("source")
        .agg(F.min("col_idx").alias("currency_idx"))
    )
    said = trimmed(F.element_at("cells", F.col("currency_idx") + 1))
    distinct = (
        rows.where(~F.col("filled"))
        .join(found, "source")
        .select("source", "currency_idx", said.alias("said"))
        .groupBy("source", "currency_idx", "said")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return distinct.groupBy("source", "currency_idx").agg(
        F.count_if(F.col("said") != "").alias("n_said"),
        F.min(F.when(F.col("said") != "", F.col("said"))).alias("one"),
    ).select(
        "source",
        "currency_idx",
        F.when(F.col("n_said") == 1, F.col("one")).alias("currency"),
        (F.col("n_said") > 1).alias("mixed"),
    )


def entity_labels(rows: DataFrame, columns: DataFrame, groups: DataFrame) -> DataFrame:
    """``source, key, label, first_name, renamed`` where entities are split by an id.

    The name column must give an id one name per day; among those, the one that tells
    most ids apart wins, then file order. The label is the name on the id's last day,
    and two ids that want the same name both get their id appended.
    """
    by_id = groups.where(N.is_identifier(F.col("group_by"))).select("source", "group_idx")
    texts = (
        columns.where((F.col("role") == "text") & ~N.is_identifier(F.col("name")))
        .where("n_blank = 0")
        .groupBy("source")
        .agg(F.collect_list("col_idx").alias("idx"))
    )
    keyed = rows.join(by_id, "source").join(texts, "source").select(
        "source",
        "day",
        "row_num",
        trimmed(F.element_at("cells", F.col("group_idx") + 1)).alias("key"),
        _said("idx"),
    ).select("source", "day", "row_num", "key", "said.*")
    at = file_position(F.col("day"), F.col("row_num"))
    # The name is a grouping key and positions are numbers, so the pass over rows combines
    # in hash tables; what is left per id is its few different names, written once.
    per_value = landed(
        keyed.groupBy("source", "col_idx", "key", "value").agg(
            F.min(at).alias("first_at"),
            F.max(at).alias("last_at"),
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.bool_or(F.col("day").isNull()).alias("undated"),
        ),
        "names",
    )
    # Names can share a day only where their spans meet. Rows are gone through once more for
    # ids with such names, and for no others.
    id_of = ["source", "col_idx", "key"]
    before = W.partitionBy(*id_of).orderBy("first_day").rowsBetween(W.unboundedPreceding, -1)
    meet = F.col("first_day") <= F.max("last_day").over(before)
    meeting = (
        per_value.withColumn("meets", meet)
        .groupBy(*id_of)
        .agg(F.bool_or("meets").alias("meets"), F.count_if("undated").alias("n_undated"))
        .where("meets or n_undated > 1")
        .select(*[F.col(c).alias(f"m_{c}") for c in id_of])
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in id_of])
    two_names = (
        keyed.join(landed(meeting, "meeting"), same, "left_semi")
        .groupBy(*id_of, "day", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy(*id_of, "day")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("source", "col_idx")
        .distinct()
    )
    per_key = per_value.groupBy(*id_of).agg(
        F.min_by("value", "first_at").alias("first_name"),
        F.max_by("value", "last_at").alias("last_name"),
    )
    per_name = per_key.groupBy("source", "col_idx", "last_name").agg(
        F.count(F.lit(1)).alias("n_keys")
    )
    best = (
        per_name.groupBy("source", "col_idx")
        .agg(F.count(F.lit(1)).alias("score"))
        .join(two_names, ["source", "col_idx"], "left_anti")
        .groupBy("source")
        .agg(F.min_by("col_idx", F.struct(-F.col("score"), F.col("col_idx"))).alias("col_idx"))
    )
    shared = per_name
    label = F.when(
        F.col("n_keys") > 1, F.format_string("%s (%s)", F.col("last_name"), F.col("key"))
    ).otherwise(F.col("last_name"))
    return (
        per_key.join(best, ["source", "col_idx"], "left_semi")
        .join(shared, ["source", "col_idx", "last_name"])
        .select(
            "source",
            "key",
            label.alias("label"),
            "first_name",
            "last_name",
            (F.col("first_name") != F.col("last_name")).alias("renamed"),
            F.col("col_idx").alias("label_idx"),
        )
    )
