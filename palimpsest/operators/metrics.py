"""Counts, rates, scopes and shares over laws, votes and extraction runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import parts

#: Rows of a part of groups, whose pairs one task counts.
EACH = 250_000


def zero_filled(rows: DataFrame, by: list[str], status: str, allowed: DataFrame) -> DataFrame:
    """Counts for every group and every allowed status, 0 where there is none."""
    counts = rows.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.select(*by).distinct().withColumn(status, F.explode(F.array(*(F.lit(r[0]) for r in allowed.select(status).distinct().orderBy(status).collect()))))
    return grid.join(counts, [*by, status], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def graduation(uses: DataFrame, pattern: str, status: str, approved: str, rejected: str, pending: str, least: int = 10, rate: float = 0.95) -> DataFrame:
    """Of each pattern: uses, outcomes, success rate among the reviewed, and whether it may graduate."""
    out = uses.groupBy(pattern).agg(
        F.count(F.lit(1)).alias("uses"), F.count_if(F.col(status) == approved).alias("approved"), F.count_if(F.col(status) == rejected).alias("rejected"), F.count_if(F.col(status) == pending).alias("pending")
    )
    share = F.coalesce(F.try_divide(F.col("approved"), F.col("approved") + F.col("rejected")), F.lit(0.0))
    return out.withColumn("success_rate", F.round(share, 6)).withColumn("eligible", (F.col("uses") >= least) & (share >= rate))


def shares(rows: DataFrame, by: list[str], item: str, top: int) -> DataFrame:
    """The `top` items of each group by count (ties: the smaller item) with their share of the group."""
    counts = rows.groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), item))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumns({"rank": rank, "share": F.round(F.col("n") / total, 6)}).where(F.col("rank") <= top)


def scope(sections: Column) -> Column:
    """narrow up to 5 sections, moderate up to 50, else broad."""
    return F.when(sections <= 5, "narrow").when(sections <= 50, "moderate").otherwise("broad")


def scope_distribution(sizes: DataFrame, size: str) -> DataFrame:
    return sizes.withColumn("scope", scope(F.col(size))).groupBy("scope").agg(
        F.count(F.lit(1)).alias("laws"), F.round(F.avg(size), 6).alias("mean"), F.percentile(size, F.lit(0.5)).alias("median"), F.max(size).alias("largest"), F.round(F.stddev_samp(size), 6).alias("stddev")
    )


def productivity(rows: DataFrame, period: str, size: str, omnibus: int = 50) -> DataFrame:
    return rows.groupBy(period).agg(F.count(F.lit(1)).alias("laws"), F.sum(size).alias("changes"), F.round(F.avg(size), 6).alias("average"), F.count_if(F.col(size) >= omnibus).alias("omnibus"))


def impact(parents: DataFrame, children: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Children's measures summed before the join, so that joining more than one child table doesn't multiply them."""
    own = children.groupBy(key).agg(*(m.alias(n) for n, m in measures.items()))
    return parents.join(own, key, "left")


def counters(changes: DataFrame, law: str = "law_id", kind: str = "change_type") -> DataFrame:
    """Added, modified (with deleted) and repealed sections of each law."""
    one = lambda *names: F.count_if(F.col(kind).isin(*names))
    return changes.groupBy(law).agg(one("Add").alias("added"), one("Modify", "Delete").alias("modified"), one("Repeal").alias("repealed"))


def specialization(rows: DataFrame, who: str, what: str) -> DataFrame:
    """Herfindahl index of what each does: 1 if all of one kind."""
    counts = rows.groupBy(who, what).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(who))
    return counts.withColumn("p", F.col("n") / total).groupBy(who).agg(F.round(F.sum(F.col("p") * F.col("p")), 6).alias("specialization"), F.sum("n").alias("n"))


def shared_pairs(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b, shared): how many groups two members share, a being the smaller; groups have few members.

    Pairs are mostly different ones, so that to count them before they are dealt out would hold
    nearly all of a task's pairs; groups and pairs are dealt to parts that grow in number, not in size.
    """
    n = parts(rows, EACH)
    one = rows.select(F.col(group).alias("_g"), F.col(member).alias("a")).repartition(n, "_g").distinct()
    pairs = one.join(one.withColumnRenamed("a", "b").hint("merge"), "_g").where("a < b").select("a", "b")
    return pairs.repartition(n, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
