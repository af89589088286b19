"""Upkeep of tables: what a backfill changes, replacements inside notes, changes as stored, and reports of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of `new` that differ from those of `old` in any column, compared as JSON where they are nested."""
    def plain(df: DataFrame) -> list[Column]:
        return [F.to_json(c) if df.schema[c].dataType.typeName() in ("struct", "array", "map") else F.col(c) for c in new.columns if c not in key]

    a = old.select(*key, F.struct(*(x.alias(f"c{i}") for i, x in enumerate(plain(old)))).alias("_old"))
    b = new.withColumn("_new", F.struct(*(x.alias(f"c{i}") for i, x in enumerate(plain(new)))))
    return b.join(a, key, "left").where(~F.col("_new").eqNullSafe(F.col("_old"))).drop("_old", "_new")


def backfilled(rows: DataFrame, key: list[str], column: str, value: Column, dry_run: bool = True) -> DataFrame:
    """The rows whose column a backfill changes, with the new value; of a dry run, their number alone."""
    changed = rows.withColumn("_value", value).where(~F.col("_value").eqNullSafe(F.col(column)))
    return changed.agg(F.count(F.lit(1)).alias("changed")) if dry_run else changed.withColumn(column, F.col("_value")).drop("_value")


def last_modified(citations: DataFrame, key: list[str]) -> DataFrame:
    """The newest date of each section's citations that aren't the original act's; without any, the newest of all."""
    newest = lambda when: F.max(F.when(when, F.col("date")))
    return citations.groupBy(*key).agg(F.coalesce(newest(~F.col("is_original")), F.max("date")).alias("last_modified"))


def replaced_in(notes: Column, pattern: str, to: str) -> Column:
    """Notes with a pattern replaced in their text; those without it stay as they are."""
    return F.transform(notes, lambda n: n.withField("content", F.when(n["content"].rlike(pattern), F.regexp_replace(n["content"], pattern, to)).otherwise(n["content"])))


def stored_changes(changes: DataFrame, laws: DataFrame, law: list[str]) -> DataFrame:
    """Changes as stored: in effect from their own date, else from the law's enactment."""
    return changes.join(laws.select(*law, "enacted_date"), law, "left").withColumn("effective_date", F.coalesce("effective_date", "enacted_date")).drop("enacted_date")


def change_description(kind: Column, title: Column, section: Column, old: Column, new: Column) -> Column:
    """'Modify 17 U.S.C. § 106: "x" → "y"', with texts cut at 50 characters."""
    short = lambda x: F.concat(F.lit('"'), F.when(F.length(x) > 50, F.concat(F.substring(x, 1, 47), F.lit("..."))).otherwise(x), F.lit('"'))
    place = F.concat(kind, F.lit(" "), title.cast("string"), F.lit(" U.S.C. § "), section)
    said = F.when(old.isNotNull() & new.isNotNull(), F.concat(F.lit(": "), short(old), F.lit(" → "), short(new))).when(new.isNotNull(), F.concat(F.lit(": + "), short(new))).when(old.isNotNull(), F.concat(F.lit(": - "), short(old))).otherwise("")
    return F.concat(place, said)


def diff_report(edits: DataFrame, law: list[str]) -> DataFrame:
    """For each law: edits that gave a change, those skipped for review, those without a section, and changes by kind."""
    resolved = F.col("section_number").isNotNull() & F.col("title_number").isNotNull()
    made = resolved & ~F.col("needs_review")
    kinds = edits.where(made).groupBy(*law, "change_type").agg(F.count(F.lit(1)).alias("n")).groupBy(*law).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("change_type", "n")))).alias("by_type"))
    counts = edits.groupBy(*law).agg(F.count_if(made).alias("generated"), F.count_if(resolved & F.col("needs_review")).alias("skipped"), F.count_if(~resolved).alias("unresolved"))
    return counts.join(kinds, law, "left")


def enriched_citations(rows: DataFrame, key: list[str], titles: DataFrame) -> DataFrame:
    """Sections whose lists of citations carry each law's title, where it is known, in their order."""
    cited = rows.select(*key, F.posexplode("citations").alias("_at", "_c")).withColumns({"congress": F.col("_c.congress"), "law_number": F.col("_c.law_number")})
    named = cited.join(titles.select("congress", "law_number", F.col("title").alias("_title")), ["congress", "law_number"], "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_at", F.struct("congress", "law_number", F.col("_title").alias("title")).alias("c")))), lambda x: x["c"])
    return rows.drop("citations").join(named.groupBy(*key).agg(listed.alias("citations")), key, "left")


def with_text(snapshots: DataFrame) -> DataFrame:
    """How many sections of each title would get a first version of their history; nothing is written."""
    return snapshots.groupBy("title_number").agg(F.count("text_content").alias("sections"))
