"""Grouped statistics of usage, ingestion, queues and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def query_statistics(runs: DataFrame, latency: str, created: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of runs, average latency and latest time; in total or for each group."""
    out = runs.groupBy(*by).agg(F.count("*").alias("n_queries"), F.avg(latency).alias("avg_latency"), F.max(created).alias("last_query_at"))
    return out.orderBy(F.desc("n_queries"), *by) if by else out


def sums_or_zero(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), latest: str | None = None) -> DataFrame:
    """Sums where nothing sums up to zero instead of null, a row count, and the latest time."""
    aggregates = [F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in columns]
    if latest:
        aggregates.append(F.max(latest).alias(f"last_{latest}"))
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), *aggregates)


def period_spine(spark, last_period: str, months: int) -> DataFrame:
    """``months`` period keys (YYYY-MM) up to and with ``last_period``."""
    last = F.to_date(F.lit(f"{last_period}-01"))
    return spark.range(1).select(F.explode(F.sequence(F.add_months(last, -(months - 1)), last, F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("period_key"))


def on_spine(sums: DataFrame, spine: DataFrame, value: str) -> DataFrame:
    """(period_key, value) for every key of the spine; zero where there is nothing."""
    return spine.join(sums, "period_key", "left").select("period_key", F.coalesce(value, F.lit(0)).alias(value))


def conditional_counts(rows: DataFrame, conditions: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One pass over the rows for any number of counts; a row may fall under several."""
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def distinct_over(rows: DataFrame, by: Sequence[str], item: str, least: int, out: str = "n_distinct") -> DataFrame:
    """Groups with at least ``least`` distinct items."""
    return rows.groupBy(*by).agg(F.countDistinct(item).alias(out)).where(F.col(out) >= least)


def top_groups(rows: DataFrame, key: Column, name: str, k: int, out: str = "n") -> DataFrame:
    """The ``k`` most frequent values of an expression; ties by value."""
    return rows.select(key.alias(name)).groupBy(name).agg(F.count("*").alias(out)).orderBy(F.desc(out), name).limit(k)


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1. The rank limit runs before the shuffle too."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_of_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], deal: str, k: int, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group. They are sought among the first ``k`` of each of ``salts`` shares of a group (dealt by the
    column ``deal``), so one task sees ``k * salts`` rows of a group at most, however many tasks and rows there are."""
    shares = top_per_group(rows.withColumn("__salt", F.pmod(F.xxhash64(deal), F.lit(salts))), [*by, "__salt"], order, k, "__n")
    return top_per_group(shares.drop("__n", "__salt"), by, order, k, "__n").drop("__n")


def event_counts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Counts of named events, where a row stands for none, one or several (each once); all names are listed."""
    names = F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    counted = rows.select(F.explode(names).alias("event")).groupBy("event").agg(F.count("*").alias("n"))
    listed = rows.sparkSession.createDataFrame([(n,) for n in rules], "event string")
    return listed.join(F.broadcast(counted), "event", "left").select("event", F.coalesce("n", F.lit(0)).alias("n"))  # as many rows as rules


def metric_series(samples: DataFrame, by: Sequence[str], value: str, ts: str, order: str, window: int = 2048) -> DataFrame:
    """Count, sum, least, most, last value, and p50/p95/p99 by linear interpolation over the latest ``window`` samples. The
    totals are partial aggregates; only the latest samples of each group are sorted."""
    totals = samples.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.max_by(value, F.struct(ts, order)).alias("last"))
    latest = first_of_group(samples.select(*by, value, ts, order), by, [F.desc(ts), F.desc(order)], order, window)
    recent = latest.groupBy(*by).agg(*[F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)]).withColumnsRenamed({c: f"__{c}" for c in by})
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return totals.join(recent, match).drop(*[f"__{c}" for c in by])


def cumulative_histogram(samples: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(le, n): how many samples are at most each bound, and all under "+Inf"; counted once."""
    names = [f"{b:g}" for b in bounds]
    counts = samples.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(n) for b, n in zip(bounds, names, strict=True)], F.count(value).alias("+Inf"))
    pairs = F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"`{n}`").alias("n")) for n in [*names, "+Inf"]])
    return counts.select(*by, F.explode(pairs).alias("x")).select(*by, "x.le", "x.n")


def prometheus_lines(histogram: DataFrame, metric: str, label: str) -> DataFrame:
    """Text exposition lines of a cumulative histogram with one label column."""
    line = F.format_string(metric + '_bucket{' + label + '="%s",le="%s"} %d', F.col(label), F.col("le"), F.col("n"))
    return histogram.select(line.alias("line"))


def alert_rules(values: DataFrame, rules: Sequence[tuple[str, str, float | None]]) -> DataFrame:
    """(rule, value, threshold, state) from a one-row table: each rule compares a column with its threshold; a
    rule without one, or a null value, is unavailable."""
    rows = []
    for name, column, threshold in rules:
        value = F.col(column).cast("double")
        state = F.when(F.lit(threshold).isNull() | value.isNull(), "unavailable").when(value > F.lit(threshold), "triggered").otherwise("ok")
        rows.append(F.struct(F.lit(name).alias("rule"), value.alias("value"), F.lit(threshold).cast("double").alias("threshold"), state.alias("state")))
    return values.select(F.explode(F.array(*rows)).alias("x")).select("x.*")

