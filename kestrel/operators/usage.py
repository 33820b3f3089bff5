"""Usage analytics: token counters by session, model and project, priced by a rate card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

COUNTERS = ("input_tokens", "output_tokens", "cache_read", "cache_write")
#: USD per million tokens for models that the rate card doesn't list.
DEFAULT_RATES = {"input": 5.0, "output": 25.0, "cache_read": 0.5, "cache_write": 6.25}


def records_from_sales(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Usage records from sales lines: order as session, brand as model, supplier as project."""
    return lineitem.join(part.select("p_partkey", "p_brand"), lineitem.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("session_id"),
        F.col("p_brand").alias("model"),
        F.col("l_suppkey").alias("project_key"),
        F.col("l_quantity").cast("long").alias("input_tokens"),
        F.floor("l_extendedprice").cast("long").alias("output_tokens"),
        F.round(F.col("l_discount") * 100).cast("long").alias("cache_read"),
        F.round(F.col("l_tax") * 100).cast("long").alias("cache_write"),
        F.col("l_shipdate").alias("ts"),
    )


def rate_card(spark: SparkSession) -> DataFrame:
    """Rates of three brands; all others fall back to the default."""
    rows = [("Brand#11", 3.0, 15.0, 0.3, 3.75), ("Brand#12", 15.0, 75.0, 1.5, 18.75), ("Brand#13", 0.8, 4.0, 0.08, 1.0)]
    return spark.createDataFrame(rows, "model string, r_input double, r_output double, r_cache_read double, r_cache_write double")


def _rate(name: str) -> Column:
    return F.coalesce(F.col(f"r_{name}"), F.lit(DEFAULT_RATES[name]))


def cost_by_model(records: DataFrame, rates: DataFrame) -> DataFrame:
    """Sums per model, then priced: the rate card has a row per model and is broadcast."""
    sums = records.groupBy("model").agg(*(F.sum(c).alias(c) for c in COUNTERS), F.count("*").alias("calls"))
    priced = sum((F.col(c) * _rate(c.removesuffix("_tokens")) for c in COUNTERS), F.lit(0.0)) / 1e6
    return sums.join(F.broadcast(rates), "model", "left").select("model", *COUNTERS, "calls", F.round(priced, 4).alias("cost_usd"))


def by_session_model(records: DataFrame) -> DataFrame:
    """Counters and calls per session and model (A1)."""
    return records.groupBy("session_id", "model").agg(*(F.sum(c).alias(c) for c in COUNTERS), F.count("*").alias("calls"))


def model_totals(records: DataFrame) -> DataFrame:
    """Totals per model, and of all models under 'ALL' (A2)."""
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    return records.rollup("model").agg(*sums).select(F.coalesce("model", F.lit("ALL")).alias("model"), *COUNTERS)


def project_breakdown(records: DataFrame) -> DataFrame:
    """Billable tokens (no cache reads) and sessions per project (A3, Q4)."""
    billable = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_write")
    return records.groupBy("project").agg(F.sum(billable).alias("billable"), F.countDistinct("session_id").alias("sessions"))


def cache_efficiency(records: DataFrame, rates: DataFrame) -> DataFrame:
    """Share of cache reads among input tokens in percent, 0 without any, and what they saved in USD (A4, A5)."""
    sums = records.groupBy("model").agg(*(F.sum(c).alias(c) for c in COUNTERS))
    seen = F.col("cache_read") + F.col("input_tokens") + F.col("cache_write")
    saved = F.col("cache_read") * (_rate("input") - _rate("cache_read")) / 1e6
    rows = sums.join(F.broadcast(rates), "model", "left")
    return rows.select("model", F.round(F.coalesce(F.try_divide(F.col("cache_read") * 100.0, seen), F.lit(0.0)), 4).alias("efficiency"), F.round(saved, 6).alias("saved_usd"))


def what_if(records: DataFrame, rates: DataFrame) -> DataFrame:
    """All tokens priced at each model of the rate card (A7); the card has a few rows."""
    total = records.agg(*(F.sum(c).alias(c) for c in COUNTERS))
    cost = sum((F.col(c) * _rate(c.removesuffix("_tokens")) for c in COUNTERS), F.lit(0.0)) / 1e6
    return F.broadcast(rates).join(total).select("model", F.round(cost, 4).alias("cost_usd"))


def active_sessions(records: DataFrame, history: DataFrame) -> DataFrame:
    """Records of sessions that the history lists (J2): a session counts whole, as the history names it (Q1)."""
    return records.join(history.select("session_id").distinct(), "session_id", "left_semi")


def trend(daily: DataFrame, value: str, day: str = "day") -> DataFrame:
    """Each day's change against the day before in percent, and its bar's length in percent of the greatest value.

    The table has a row per day, so one ordered window holds it.
    """
    before = F.lag(value).over(Window.orderBy(day))
    change = F.round(F.try_divide((F.col(value) - before) * 100.0, before), 4)
    return daily.select(day, value, change.alias("change"), F.round(F.col(value) * 100.0 / F.max(value).over(Window.partitionBy()), 4).alias("bar"))


def daily_series(daily: DataFrame, value: str, first: str, last: str) -> DataFrame:
    """A row for each day of the period, zero where nothing was recorded."""
    spark = daily.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(daily, "day", "left").select("day", F.coalesce(value, F.lit(0)).alias(value))
