"""Sparse snapshots on a chain of revisions: states, histories and real changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

KEY = ["title_number", "section_number"]
#: Links that the driver takes at most to walk a chain.
MOST_WALKED = 100_000


def revision_chain(revisions: DataFrame, head: int, id_col: str = "revision_id", parent_col: str = "parent_revision_id") -> DataFrame:
    """(revision_id, chain_pos) from `head` (position 0) to the root, over parent links.

    Up to MOST_WALKED links are walked by the driver. Beyond that, each round doubles how far every
    revision's link reaches, so that a chain of n revisions needs log2(n) joins on the narrow link
    table. Links into nothing and repeated ids end the chain.
    """
    links = revisions.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("up")).dropDuplicates(["id"])
    few = links.limit(MOST_WALKED + 1).collect()
    if len(few) <= MOST_WALKED:
        up = {r["id"]: r["up"] for r in few}
        walk: dict[int, int] = {}
        at: int | None = head
        while at in up and at not in walk:
            walk[at] = len(walk)
            at = up[at]
        return revisions.sparkSession.createDataFrame(list(walk.items()), f"{id_col} long, chain_pos long")
    chain = links.where(F.col("id") == head).select("id", F.lit(0).cast("long").alias("chain_pos"))
    jump, step = links.where("up is not null and up <> id"), 1
    while True:
        reached = chain.join(jump, "id").select(F.col("up").alias("id"), (F.col("chain_pos") + step).alias("chain_pos"))
        reached = reached.join(links.select("id"), "id", "left_semi").join(chain.select("id"), "id", "left_anti")
        if not reached.head(1):
            return chain.select(F.col("id").alias(id_col), "chain_pos")
        chain = cut(chain.unionByName(reached))
        far = jump.select(F.col("id").alias("up"), F.col("up").alias("far"))
        jump = cut(jump.join(far, "up").select("id", F.col("far").alias("up")))
        step *= 2


def states_at(snapshots: DataFrame, chain: DataFrame, key: list[str] | None = None, tie: str = "snapshot_id") -> DataFrame:
    """The newest snapshot of each key along the chain, without keys whose newest one is a tombstone.

    A hash aggregate keeps the least (chain_pos, tie); revisions off the chain don't count; the
    tombstones go after the newest is known, so that they hide what is older.
    """
    key = key or KEY
    rows = snapshots.join(chain, "revision_id")
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("chain_pos", tie)).alias("_s"))
    return newest.select(*key, *(F.col(f"_s.{c}").alias(c) for c in rest)).where(~F.coalesce("is_deleted", F.lit(False)))


def two_states(snapshots: DataFrame, before: DataFrame, after: DataFrame, columns: list[str], key: list[str] | None = None, tie: str = "snapshot_id") -> DataFrame:
    """The states of each key along two chains side by side, by one aggregate over the snapshots: `columns` with the suffixes _a and _b, and in_a and in_b, true where the key has a state there and null where it has none."""
    key = key or KEY
    rows = snapshots.join(before.select("revision_id", F.col("chain_pos").alias("_pos_a")), "revision_id", "left").join(after.select("revision_id", F.col("chain_pos").alias("_pos_b")), "revision_id", "left")
    rows = rows.where("_pos_a IS NOT NULL OR _pos_b IS NOT NULL")
    row = F.struct(*columns, F.coalesce("is_deleted", F.lit(False)).alias("_gone"))
    newest = lambda pos: F.min_by(row, F.when(F.col(pos).isNotNull(), F.struct(pos, tie)))
    both = rows.groupBy(*key).agg(newest("_pos_a").alias("_a"), newest("_pos_b").alias("_b"))
    out = []
    for side in ("a", "b"):
        live = F.when(~F.col(f"_{side}._gone"), True)
        out += [F.when(live, F.col(f"_{side}.{c}")).alias(f"{c}_{side}") for c in columns] + [live.alias(f"in_{side}")]
    return both.select(*key, *out).where("in_a OR in_b")


def history(snapshots: DataFrame, revisions: DataFrame, title: int, section: str) -> DataFrame:
    """All snapshots of one section with their revisions, in sequence."""
    own = snapshots.where((F.col("title_number") == title) & (F.col("section_number") == section))
    return own.join(revisions, "revision_id").orderBy("sequence_number", "snapshot_id")


def changed_at(snapshots: DataFrame, revision: int) -> DataFrame:
    """Snapshots written exactly at one revision."""
    return snapshots.where(F.col("revision_id") == revision)


def real_changes(snapshots: DataFrame, chain: DataFrame, key: list[str] | None = None, hash_col: str = "text_hash", tie: str = "snapshot_id") -> DataFrame:
    """Snapshots whose text differs from the next older one of their key on the chain.

    A missing older hash, or a missing one of its own, counts as a change.
    """
    older = F.lead(hash_col).over(Window.partitionBy(*(key or KEY)).orderBy("chain_pos", tie))
    rows = snapshots.join(chain, "revision_id").withColumn("older_hash", older)
    return rows.where(F.col("older_hash").isNull() | F.col(hash_col).isNull() | (F.col("older_hash") != F.col(hash_col)))


def last_changed(snapshots: DataFrame, chain: DataFrame, key: list[str] | None = None, hash_col: str = "text_hash", tie: str = "snapshot_id") -> DataFrame:
    """The newest real change of each key."""
    key = key or KEY
    rows = real_changes(snapshots, chain, key, hash_col, tie)
    return rows.groupBy(*key).agg(F.min_by(F.struct("revision_id", tie), F.struct("chain_pos", tie)).alias("_s")).select(*key, "_s.*")


def live_counts(states: DataFrame, by: str = "title_number") -> DataFrame:
    return states.groupBy(by).agg(F.count(F.lit(1)).alias("live_sections"))


def duplicate_keys(snapshots: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Keys written more than once in one revision, which `states_at` decides by the smallest id."""
    return snapshots.groupBy("revision_id", *(key or KEY)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def batch_lookup(states: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """States of the wanted keys only; a semi-join, so that repeated keys don't repeat states."""
    return states.join(keys.select(*on).distinct(), on, "left_semi")


def head_revision(revisions: DataFrame) -> DataFrame:
    """The ingested revision with the largest sequence number."""
    return revisions.where(F.col("status") == "Ingested").orderBy(F.desc("sequence_number"), F.desc("revision_id")).limit(1)


def last_derived_before(revisions: DataFrame, sequence: Column | int) -> DataFrame:
    """The newest revision before a sequence number that isn't ground truth."""
    return revisions.where((F.col("sequence_number") < sequence) & ~F.col("is_ground_truth")).orderBy(F.desc("sequence_number"), F.desc("revision_id")).limit(1)


def closed_versions(versions: DataFrame, key: list[str], date_col: str = "effective_date", tie: str = "version_id") -> DataFrame:
    """Version numbers from 1 and the date at which each version is superseded (null for the newest)."""
    w = Window.partitionBy(*key).orderBy(date_col, tie)
    return versions.withColumns({"version": F.row_number().over(w), "superseded_date": F.lead(date_col).over(w)})


def blame(snapshots: DataFrame, chain: DataFrame, key: list[str] | None = None) -> DataFrame:
    """For each line of the newest state, the oldest revision since which that line has stayed.

    Lines are the non-empty ones of text_content, known by their hashes; a line that goes and comes
    back belongs to the revision in which it came back.
    """
    key = key or KEY
    rows = snapshots.join(chain, "revision_id")
    w = Window.partitionBy(*key).orderBy(F.desc("chain_pos"), F.desc("snapshot_id"))
    ranked = rows.withColumn("n", F.row_number().over(w)).withColumn("newest", F.max("n").over(Window.partitionBy(*key)))
    lines = ranked.select(*key, "revision_id", "n", "newest", F.posexplode(F.split("text_content", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    lines = lines.withColumn("line_hash", F.sha2("line", 256))
    seen = lines.select(*key, "line_hash", "n", "revision_id", "newest").dropDuplicates([*key, "line_hash", "n"])
    run = F.col("n") - F.row_number().over(Window.partitionBy(*key, "line_hash").orderBy("n"))
    runs = seen.withColumn("run", run).groupBy(*key, "line_hash", "run").agg(F.max("n").alias("last"), F.min_by("revision_id", "n").alias("since_revision"), F.max("newest").alias("newest"))
    now = lines.where("n = newest").select(*key, F.col("pos").alias("line_number"), "line", "line_hash")
    return now.join(runs.where("last = newest").select(*key, "line_hash", "since_revision"), [*key, "line_hash"])
