"""Statistics over the attributes of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as t

PLACES = 6
DAYS_A_YEAR = 365.25
PERCENTILES = [0.1, 0.25, 0.75, 0.9, 0.95]
OUTDATED_DAYS = 730


def has_value(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def length_stats(df: DataFrame, x: str, limits: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """n, n_known, mean, median, max, and how many exceed each limit: one row."""
    c = F.col(x)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count(c).alias("n_known"), F.round(F.avg(c), PLACES).alias("mean"), F.round(F.percentile(c, 0.5), PLACES).alias("median"), F.max(c).alias("max"), *(F.count_if(c > n).alias(f"over_{n}") for n in limits)
    )


def percentiles(df: DataFrame, x: str, shares: list[float] | None = None) -> DataFrame:
    """A column per percentile, interpolated linearly, exact: one row, null for no values."""
    return df.agg(*(F.round(F.percentile(F.col(x), p), PLACES).alias(f"p{round(p * 100)}") for p in shares or PERCENTILES))


def value_counts(df: DataFrame, x: str) -> DataFrame:
    """value, n: blank and null values together as "(missing)"."""
    return df.groupBy(F.coalesce(t.first_value(F.col(x)), F.lit("(missing)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_docs, percent, n_values: how many rows have a value, and how many different ones there are. One pass."""
    long = df.select(*(F.col(f).cast("string").alias(f) for f in fields)).unpivot([], fields, "field", "value")
    return long.groupBy("field").agg(
        F.count_if(has_value(F.col("value"))).alias("n_docs"), F.round(100 * F.avg(has_value(F.col("value")).cast("double")), PLACES).alias("percent"), F.count_distinct(F.when(has_value(F.col("value")), F.trim("value"))).alias("n_values")
    )


def multivalue_counts(df: DataFrame, fields: list[str], sign: str = ",") -> DataFrame:
    """field, value, n: values divided at a sign, trimmed, blanks dropped."""
    long = df.unpivot([], fields, "field", "packed").where(F.col("packed").isNotNull())
    parts = F.filter(F.transform(F.split("packed", sign), lambda x: F.trim(x)), lambda x: x != "")
    return long.select("field", F.explode(parts).alias("value")).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def unique_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n: whole values, blanks dropped."""
    long = df.select(*(F.col(f).cast("string").alias(f) for f in fields)).unpivot([], fields, "field", "value")
    return long.where(has_value(F.col("value"))).groupBy("field", F.trim("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def lenient_date(c: Column) -> Column:
    """A date written year-month-day, with or without leading zeros; null for anything else and for impossible dates."""
    return F.when(c.rlike(r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*$"), F.to_date(F.try_to_timestamp(F.trim(c), F.lit("yyyy-M-d"))))


def age_days(date: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), date)


def age_stats(df: DataFrame, date: str, as_of: str) -> DataFrame:
    """n, n_dated, n_outdated, mean and median years, first and last date: one row. Dates are read leniently."""
    d = lenient_date(F.col(date))
    days = df.select(d.alias("d"), age_days(d, as_of).alias("days"))
    years = F.col("days") / DAYS_A_YEAR
    return days.agg(
        F.count(F.lit(1)).alias("n"), F.count("d").alias("n_dated"), F.count_if(F.col("days") > OUTDATED_DAYS).alias("n_outdated"), F.round(F.avg(years), PLACES).alias("mean_years"), F.round(F.percentile(years, 0.5), PLACES).alias("median_years"), F.min("d").alias("first_date"), F.max("d").alias("last_date")
    )


def step_histogram(df: DataFrame, x: str, step: float) -> DataFrame:
    """low, n: counts in steps from 0 to the highest value, empty steps included; the last one holds its right edge.

    Values below 0 and nulls are left out.
    """
    known = df.where(F.col(x) >= 0)
    most = known.agg(F.max(x).alias("_most"))
    last = F.greatest(F.lit(0), F.ceil(F.col("_most") / step).cast("int") - 1)
    placed = known.crossJoin(F.broadcast(most)).groupBy(F.least(F.floor(F.col(x) / step).cast("int"), last).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    steps = most.where(F.col("_most").isNotNull()).select(F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return steps.join(placed, "k", "left").select(F.round(F.col("k") * step, PLACES).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def equal_width(df: DataFrame, x: str, bins: int) -> DataFrame:
    """bin (int, from 1), n: so many bins of equal width from the least to the greatest value, which is in the last; empty ones left out."""
    edges = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    k = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int") + 1, F.lit(bins))).otherwise(1)
    return df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def zero_filled(df: DataFrame, x: str, low: int, high: int) -> DataFrame:
    """value (int), n: a row for every whole number from low to high, and one, null, for those above."""
    counts = df.where(F.col(x) >= low).groupBy(F.when(F.col(x) <= high, F.col(x).cast("int")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("value")).unionByName(df.sparkSession.createDataFrame([(None,)], "value int"))
    return every.alias("e").join(counts.alias("c"), F.col("e.value").eqNullSafe(F.col("c.value")), "left").select("e.value", F.coalesce("n", F.lit(0)).alias("n"))


def approved_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """n, n_label, n_date, n_label_without_date: approval labels and dates within the first 500 characters."""
    head = F.substring(F.col(text), 1, 500)
    label = F.coalesce(head.contains("Godkänt den:"), F.lit(False))
    d = t.approved_date(F.col(text))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("n_label"), F.count_if(d.isNotNull()).alias("n_date"), F.count_if(label & d.isNull()).alias("n_label_without_date"))


def latest_records(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the order given: pages that were fetched again."""
    last = df.groupBy(key).agg(F.max(F.struct(*order)).alias("_last"))
    return df.withColumn("_last", F.struct(*order)).join(last, [key, "_last"], "left_semi").drop("_last")


def backfill(df: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """df with missing values of a column filled from another table by key; values that are there stay."""
    other = known.groupBy(key).agg(F.max(column).alias("_known"))
    return df.join(other, key, "left").withColumn(column, F.coalesce(F.col(column), F.col("_known"))).drop("_known")
