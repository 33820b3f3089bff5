"""Findings as reports: filters, plans, groups and rendered text; and JSON payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kestrel.operators import shared

#: Severities from worst to least.
SEVERITIES = ["critical", "high", "medium", "low", "info"]


def rank(severity: Column) -> Column:
    """0 for the worst severity; unknown ones come last."""
    return F.coalesce(*(F.when(severity == s, i) for i, s in enumerate(SEVERITIES)), F.lit(len(SEVERITIES)))


def union(findings: list[DataFrame]) -> DataFrame:
    """All findings of several detectors, repeated ones included (U1); columns go by name."""
    return reduce(lambda a, b: a.unionByName(b), findings)


def select(findings: DataFrame, severity: str | None = None, check: str | None = None, prefix: str | None = None) -> DataFrame:
    """Findings by severity, exact check or a check's prefix."""
    for column, value in (("severity", severity), ("check_id", check)):
        findings = findings.where(F.col(column) == value) if value else findings
    return findings.where(F.col("check_id").startswith(prefix)) if prefix else findings


def action_plan(findings: DataFrame) -> DataFrame:
    """(severity, category, n): what comes first (A19); the category is the check's part before its dot."""
    counts = findings.groupBy("severity", F.substring_index("check_id", ".", 1).alias("category")).agg(F.count("*").alias("n"))
    return counts.orderBy(rank(F.col("severity")), F.desc("n"), "category")


def by_file(findings: DataFrame, shown: int = 20) -> DataFrame:
    """(path, n, worst, titles) (A20): `titles` shows the first few by severity; `n` counts them all."""
    order = [rank(F.col("severity")), F.col("title")]
    ranked = findings.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*order)))
    titles = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= shown, F.struct("_n", "title")))), lambda x: x.title)
    return ranked.groupBy("path").agg(F.count("*").alias("n"), F.min_by("severity", rank(F.col("severity"))).alias("worst"), titles.alias("titles"))


def new_only(findings: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Findings whose keys were not seen before (U4)."""
    return findings.join(seen.select(keys).distinct(), keys, "left_anti")


def up_down(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with `up` or `down` between two snapshots."""
    up = new.select(keys).distinct().join(old.select(keys), keys, "left_anti").withColumn("event", F.lit("up"))
    return up.unionByName(old.select(keys).distinct().join(new.select(keys), keys, "left_anti").withColumn("event", F.lit("down")))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def capped(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows for display (T11, Q18); operators themselves cap nothing."""
    return rows.orderBy(*order).limit(n)


def payload(rows: DataFrame) -> DataFrame:
    """(json) with a row's columns, nulls left out (K8, K9)."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def markdown(findings: DataFrame, by: str, shown: int = 20) -> DataFrame:
    """(by, report): a heading, a severity bar, the action plan and the findings by severity (K7).

    Each section shows the first `shown` findings and counts the rest, so a report's length is bounded.
    """
    severity = F.col("severity")
    ranked = findings.withColumn("_r", rank(severity)).withColumn("_n", F.row_number().over(Window.partitionBy(by, "severity").orderBy("check_id", "title")))
    item = F.when(F.col("_n") <= shown, F.struct("_n", F.concat(F.lit("- **"), "title", F.lit("** (`"), "check_id", F.lit("`): "), F.coalesce("message", F.lit(""))).alias("t")))
    parts = ranked.groupBy(by, "_r", "severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n- and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    section = F.concat(F.lit("## "), F.initcap("severity"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n"), F.array_join(F.transform("items", lambda x: x.t), "\n"), more)
    whole = F.array_sort(F.collect_list(F.struct("_r", "severity", "n", section.alias("section"))))
    reports = parts.groupBy(by).agg(whole.alias("parts"), F.sum("n").alias("total"))
    bar = F.array_join(F.transform("parts", lambda p: F.concat(p.severity, F.lit(": "), p.n.cast("string"))), " | ")
    head = F.concat(F.lit("# Report: "), F.col(by).cast("string"), F.lit("\n\n"), F.col("total").cast("string"), F.lit(" findings: "), bar, F.lit("\n\n"))
    return reports.select(by, F.concat(head, F.array_join(F.transform("parts", lambda p: p.section), "\n\n"), F.lit("\n")).alias("report"))


def replace_section(text: Column, name: str, body: Column) -> Column:
    """Text with a managed section between its marks rewritten, or appended if it has none."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    block = F.concat(F.lit(start + "\n"), body, F.lit("\n" + end))
    before, after = F.substring_index(text, start, 1), F.substring_index(text, end, -1)
    has = text.contains(start) & text.contains(end)
    return F.when(has, F.concat(before, block, after)).otherwise(F.concat(F.when(text == "", "").otherwise(F.concat(F.rtrim(text), F.lit("\n\n"))), block, F.lit("\n")))


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows with their place in an order, from 1 (T10): ports by number, projects by name or time, for a display that pages.

    Ranks are counted in ranges of the order: a range's rows number on from the sum of those before it,
    so no task sees all rows.  They are written once: ranges that are sampled anew may be others.  An order
    with ties leaves the places among them open.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed = shared.stash(placed, shared.folder(rows.sparkSession, "positions"))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_start"))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_i") + 1).drop("_p", "_i", "_start")


def append_numbered(base: DataFrame, rows: DataFrame, id_column: str, order: list[Column]) -> DataFrame:
    """Base with new rows that go on from its greatest id (K4)."""
    top = base.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    numbered = positions(rows, order, "_position").join(F.broadcast(top))
    return base.unionByName(numbered.withColumn(id_column, F.col("_top") + F.col("_position")).select(base.columns))


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Writes rows so that they replace the partitions they have rows for, others stay."""
    rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
