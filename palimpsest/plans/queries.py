"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import apply, compare, extract, intervals, metrics, provisions, relations, snapshots, xml_edits
from ..sources.tables import table
from . import standins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The revision that queries take as head, and those that they compare.
HEAD, BEFORE, AFTER = 30, 10, 20
KEY = snapshots.KEY
_CTE = f"WITH {standins.SNAPSHOTS_SQL}, {standins.REVISIONS_SQL}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _state(spark: SparkSession, d: str, head: int) -> DataFrame:
    chain = snapshots.revision_chain(standins.revisions(spark, d), head)
    return snapshots.states_at(standins.snapshots(spark, d), chain)


def _cte(head: int = HEAD) -> str:
    return _CTE.replace("{head}", str(head))


def _state_sql(head: int, chain: str = "chain") -> str:
    return f"""SELECT * FROM (
  SELECT s.*, c.chain_pos, row_number() OVER (PARTITION BY title_number, section_number ORDER BY c.chain_pos, snapshot_id) AS rn
  FROM snapshots s JOIN {chain} c USING (revision_id)) WHERE rn = 1 AND NOT coalesce(is_deleted, false)"""


def _two_states_sql() -> str:
    chain = "WITH RECURSIVE c AS (SELECT revision_id, parent_revision_id, CAST(0 AS BIGINT) AS chain_pos FROM revisions WHERE revision_id = {h} UNION ALL SELECT r.revision_id, r.parent_revision_id, c.chain_pos + 1 FROM revisions r JOIN c ON r.revision_id = c.parent_revision_id) SELECT revision_id, chain_pos FROM c"
    return f"{_cte()}, chain_a AS ({chain.format(h=BEFORE)}), chain_b AS ({chain.format(h=AFTER)}), a AS ({_state_sql(0, 'chain_a')}), b AS ({_state_sql(0, 'chain_b')})"


@query(f"{_cte()} SELECT revision_id, chain_pos FROM chain")
def revision_chain(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.revision_chain(standins.revisions(spark, d), HEAD)


@query(f"{_cte()} SELECT title_number, section_number, snapshot_id, revision_id, text_hash FROM ({_state_sql(HEAD)})")
def snapshot_at_revision(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d, HEAD).select(*KEY, "snapshot_id", "revision_id", "text_hash")


@query(f"{_cte()} SELECT title_number, count(*) AS live_sections FROM ({_state_sql(HEAD)}) GROUP BY 1")
def live_sections_per_title(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.live_counts(_state(spark, d, HEAD))


@query(f"{_cte()} SELECT snapshot_id, s.revision_id, text_hash, parent_revision_id FROM snapshots s JOIN revisions r ON s.revision_id = r.revision_id WHERE title_number = 7 AND section_number = 'click'")
def section_history(spark: SparkSession, d: str) -> DataFrame:
    revisions = standins.revisions(spark, d).withColumn("sequence_number", F.col("revision_id"))
    return snapshots.history(standins.snapshots(spark, d), revisions, 7, "click").select("snapshot_id", "revision_id", "text_hash", "parent_revision_id")


@query(f"{_cte()} SELECT snapshot_id, title_number, section_number FROM snapshots WHERE revision_id = {AFTER}")
def changed_at_revision(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.changed_at(standins.snapshots(spark, d), AFTER).select("snapshot_id", *KEY)


_REAL = """SELECT * FROM (SELECT s.snapshot_id, s.revision_id, s.title_number, s.section_number, s.text_hash, c.chain_pos,
  lead(s.text_hash) OVER (PARTITION BY title_number, section_number ORDER BY c.chain_pos, snapshot_id) AS older_hash
  FROM snapshots s JOIN chain c ON s.revision_id = c.revision_id) WHERE older_hash IS NULL OR text_hash IS NULL OR older_hash <> text_hash"""


@query(f"{_cte()} SELECT snapshot_id, title_number, section_number, older_hash FROM ({_REAL})")
def real_changes(spark: SparkSession, d: str) -> DataFrame:
    chain = snapshots.revision_chain(standins.revisions(spark, d), HEAD)
    return snapshots.real_changes(standins.snapshots(spark, d), chain).select("snapshot_id", *KEY, "older_hash")


@query(f"{_cte()} SELECT title_number, section_number, revision_id, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY title_number, section_number ORDER BY chain_pos, snapshot_id) AS rn FROM ({_REAL})) WHERE rn = 1")
def last_changed_revision(spark: SparkSession, d: str) -> DataFrame:
    chain = snapshots.revision_chain(standins.revisions(spark, d), HEAD)
    return snapshots.last_changed(standins.snapshots(spark, d), chain)


@query(f"{_cte()} SELECT revision_id, title_number, section_number, count(*) AS \"rows\" FROM snapshots GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.duplicate_keys(standins.snapshots(spark, d))


_DIFF = f"""{_two_states_sql()}, diff AS (
  SELECT coalesce(a.title_number, b.title_number) AS title_number, coalesce(a.section_number, b.section_number) AS section_number,
    CASE WHEN a.title_number IS NULL THEN 'added' WHEN b.title_number IS NULL THEN 'deleted'
         WHEN a.text_hash IS DISTINCT FROM b.text_hash OR a.notes_hash IS DISTINCT FROM b.notes_hash THEN 'modified' ELSE 'unchanged' END AS change_type,
    a.title_number IS NULL OR b.title_number IS NULL OR a.text_hash IS DISTINCT FROM b.text_hash AS text_changed,
    CASE WHEN a.title_number IS NULL THEN b.notes_hash IS NOT NULL WHEN b.title_number IS NULL THEN a.notes_hash IS NOT NULL ELSE a.notes_hash IS DISTINCT FROM b.notes_hash END AS notes_changed
  FROM a FULL OUTER JOIN b ON a.title_number = b.title_number AND a.section_number = b.section_number)"""


def _two_states(spark: SparkSession, d: str) -> DataFrame:
    revisions = standins.revisions(spark, d)
    chains = [snapshots.revision_chain(revisions, head) for head in (BEFORE, AFTER)]
    return snapshots.two_states(standins.snapshots(spark, d), *chains, ["text_hash", "notes_hash", "is_deleted"])


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return compare.diff_of(_two_states(spark, d), KEY)


@query(f"{_DIFF} SELECT * FROM diff")
def section_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


@query(f"{_DIFF} SELECT change_type, count(*) AS sections FROM diff GROUP BY 1")
def section_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return compare.diff_counts(_diff(spark, d))


_CHECK = f"""{_two_states_sql()}, o AS (SELECT coalesce(a.title_number, b.title_number) AS title_number, coalesce(a.section_number, b.section_number) AS section_number,
  CASE WHEN b.title_number IS NULL THEN 'only_derived' WHEN a.title_number IS NULL THEN 'only_truth' WHEN a.is_deleted IS DISTINCT FROM b.is_deleted THEN 'deleted_mismatch'
       WHEN a.text_hash IS DISTINCT FROM b.text_hash THEN 'text_mismatch' WHEN a.notes_hash IS DISTINCT FROM b.notes_hash THEN 'notes_mismatch' ELSE 'match' END AS outcome
  FROM a FULL OUTER JOIN b ON a.title_number = b.title_number AND a.section_number = b.section_number)"""


@query(f"{_CHECK} SELECT * FROM o")
def checkpoint_validate(spark: SparkSession, d: str) -> DataFrame:
    return compare.checkpoint_of(_two_states(spark, d), KEY)


_KINDS = ("match", "text_mismatch", "notes_mismatch", "deleted_mismatch", "only_derived", "only_truth")


@query(f"{_CHECK} SELECT count(*) AS sections, {', '.join(f'''count(*) FILTER (outcome = '{k}') AS \"{k}\"''' for k in _KINDS)}, count(*) FILTER (outcome = 'match') = count(*) AS is_clean FROM o")
def checkpoint_summary(spark: SparkSession, d: str) -> DataFrame:
    return compare.checkpoint_summary(checkpoint_validate(spark, d))


@query("SELECT c_custkey, o_orderkey, o_orderdate FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30') WHERE rn = 1")
def as_of_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return relations.as_of(rows, ["c_custkey"], "o_orderdate", F.lit("1998-06-30").cast("timestamp_ntz" if dict(rows.dtypes)["o_orderdate"] == "timestamp_ntz" else "timestamp"), "o_orderkey")


@query("SELECT e.event_id, max(p.ts) AS last_purchase FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') e LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts <= e.ts GROUP BY 1")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("last_purchase"))
    return relations.as_of_join(left, right, ["user_id"], "ts", "last_purchase", ["last_purchase"]).select("event_id", "last_purchase")


@query(f"WITH RECURSIVE {standins.NODES_SQL}, t AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM nodes UNION ALL SELECT n.parent_id, t.descendant, t.depth + 1 FROM t JOIN nodes n ON n.id = t.ancestor WHERE n.parent_id IS NOT NULL) SELECT descendant, depth FROM t WHERE ancestor = 'r1'")
def tree_descendants(spark: SparkSession, d: str) -> DataFrame:
    return relations.descendants(standins.nodes(spark, d), "r1").select(F.col("id").alias("descendant"), "depth")


@query(f"WITH RECURSIVE {standins.NODES_SQL}, t AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM nodes UNION ALL SELECT n.parent_id, t.descendant, t.depth + 1 FROM t JOIN nodes n ON n.id = t.ancestor WHERE n.parent_id IS NOT NULL) SELECT descendant, ancestor, depth FROM t WHERE depth > 0")
def tree_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return relations.closure(standins.nodes(spark, d)).where("depth > 0").select("descendant", "ancestor", "depth")


@query(f"WITH RECURSIVE {standins.NODES_SQL}, t AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM nodes UNION ALL SELECT n.parent_id, t.descendant, t.depth + 1 FROM t JOIN nodes n ON n.id = t.ancestor WHERE n.parent_id IS NOT NULL) SELECT descendant, string_agg(ancestor, '/' ORDER BY depth DESC) AS breadcrumb FROM t GROUP BY 1")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    rows = relations.closure(standins.nodes(spark, d))
    path = F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor")), asc=False), lambda x: x["ancestor"])
    return rows.groupBy("descendant").agg(F.array_join(path, "/").alias("breadcrumb"))


@query("SELECT c_custkey, c_name FROM customer WHERE (c_nationkey, c_mktsegment) IN ((3, 'BUILDING'), (7, 'MACHINERY'), (11, 'HOUSEHOLD'))")
def batch_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([(3, "BUILDING"), (7, "MACHINERY"), (11, "HOUSEHOLD"), (3, "BUILDING")], "c_nationkey int, c_mktsegment string")
    return snapshots.batch_lookup(table(spark, d, "customer"), keys, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "c_name")


@query("""WITH s AS (SELECT p_brand, max(p_size) AS owner FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1), g AS (SELECT p_type, min(p_size) AS owner FROM part GROUP BY 1)
SELECT p_partkey, coalesce(s.owner, g.owner) AS owner FROM part LEFT JOIN s USING (p_brand) LEFT JOIN g USING (p_type)""")
def override_fallback(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    specific = part.where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).groupBy("p_brand").agg(F.max("p_size").alias("owner"))
    general = part.groupBy("p_type").agg(F.min("p_size").alias("owner"))
    return relations.override(part, specific, general, ["p_brand"], ["p_type"], "owner").select("p_partkey", "owner")


@query("SELECT s_suppkey FROM supplier WHERE CAST(floor(s_acctbal / 100) AS INTEGER) <= 50 AND (s_nationkey % 3 = 0 OR CAST(floor(s_acctbal / 100) AS INTEGER) + 20 >= 50)")
def effective_range_filter(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor(F.col("s_acctbal") / 100).cast("int")
    rows = table(spark, d, "supplier").withColumns({"valid_from": start, "valid_to": F.when(F.col("s_nationkey") % 3 != 0, start + 20)})
    return rows.where(relations.valid_at("valid_from", "valid_to", F.lit(50))).select("s_suppkey")


_TERMS = [("A", "1993-01-20", "1997-01-19"), ("B", "1997-01-20", "1999-12-31"), ("C", "2001-01-20", "2005-01-19")]


@query("SELECT o_orderkey, CASE " + " ".join(f"WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in _TERMS) + " ELSE 'Unknown' END AS term FROM orders")
def range_join_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame(_TERMS, "term string, first string, last string").select("term", F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"))
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return relations.range_label(rows, "day", terms, "first", "last", "term", "Unknown").select("o_orderkey", "term")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%'")
def search_sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(relations.contains(F.col("text"), "license")).select("doc_id")


@query("""SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN p > 81 THEN '...' ELSE '' END || substr(text, greatest(p - 81, 0) + 1, least(p + 126, length(text)) - greatest(p - 81, 0)) || CASE WHEN p + 126 < length(text) THEN '...' ELSE '' END
ELSE substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END END AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents WHERE lang = 'en')""")
def search_snippet(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang = 'en'")
    return docs.select("doc_id", relations.snippet(F.col("text"), "license").alias("snippet"))


@query("""SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN p > 81 THEN '...' ELSE '' END || substr(text, greatest(p - 81, 0) + 1, least(p + 126, length(text)) - greatest(p - 81, 0)) || CASE WHEN p + 126 < length(text) THEN '...' ELSE '' END
ELSE substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END END AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents)""")
def search_snippet_all(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of documents in all languages and without one."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", relations.snippet(F.col("text"), "license").alias("snippet"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END, CASE WHEN source IN ('src0', 'src1') THEN 'default' END, 'unknown') AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def title_enrich_coalesce(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    first = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    return rows.select("doc_id", F.coalesce(first, F.when(F.col("source").isin("src0", "src1"), "default"), F.lit("unknown")).alias("label"))


_EVENTS = """e AS (
  SELECT 'public_law' AS event_type, 'L' || o_orderkey AS identifier, 100 + CAST(o_custkey % 5 AS INTEGER) AS congress, CAST(o_orderkey % 1000 AS INTEGER) AS law_number, CASE WHEN o_orderkey % 50 > 0 THEN CAST(o_orderdate AS DATE) END AS event_date FROM orders
  UNION ALL SELECT 'release_point', 'R' || c_custkey, 100 + CAST(c_custkey % 5 AS INTEGER), NULL, DATE '1995-01-01' + CAST(c_custkey AS INTEGER) FROM customer WHERE c_custkey < 1000)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d, table(spark, d, "customer").where("c_custkey < 1000"), F.col("c_custkey"))


def _timeline(spark: SparkSession, d: str, c: DataFrame, days: Column) -> DataFrame:
    o = table(spark, d, "orders")
    laws = o.select(F.lit("public_law").alias("event_type"), F.concat(F.lit("L"), "o_orderkey").alias("identifier"), (F.col("o_custkey") % 5 + 100).cast("int").alias("congress"), (F.col("o_orderkey") % 1000).cast("int").alias("law_number"), F.when(F.col("o_orderkey") % 50 > 0, F.to_date("o_orderdate")).alias("event_date"))
    points = c.select(F.lit("release_point").alias("event_type"), F.concat(F.lit("R"), "c_custkey").alias("identifier"), (F.col("c_custkey") % 5 + 100).cast("int").alias("congress"), F.lit(None).cast("int").alias("law_number"), F.date_add(F.lit("1995-01-01").cast("date"), days.cast("int")).alias("event_date"))
    return relations.timeline(laws, points)


#: All customers as release points; days are folded into a fixed span, so that large keys have dates too.
_SPAN = 10_000
_ALL_EVENTS = _EVENTS.replace("CAST(c_custkey AS INTEGER) FROM customer WHERE c_custkey < 1000", f"CAST(c_custkey % {_SPAN} AS INTEGER) FROM customer")


def _all_events(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d, table(spark, d, "customer"), F.col("c_custkey") % _SPAN)


_PLACED = f"WITH {_EVENTS}, p AS (SELECT *, row_number() OVER (ORDER BY coalesce(event_date, DATE '0001-01-01'), CASE WHEN event_type = 'public_law' THEN 0 ELSE 1 END, congress, coalesce(law_number, 0), identifier) AS position FROM e)"


@query(f"{_PLACED} SELECT identifier, event_type, congress, event_date FROM p WHERE position BETWEEN (SELECT position FROM p WHERE identifier = 'R10') AND (SELECT position FROM p WHERE identifier = 'R60')")
def timeline_slice(spark: SparkSession, d: str) -> DataFrame:
    return relations.timeline_slice(_events(spark, d), "R10", "R60").select("identifier", "event_type", "congress", "event_date")


@query(f"WITH {_EVENTS} SELECT congress, count(*) FILTER (event_type = 'release_point') AS release_points, count(*) FILTER (event_type = 'public_law') AS laws, min(event_date) AS first_date, max(event_date) AS last_date FROM e GROUP BY 1")
def timeline_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary(_events(spark, d))


def _summary(events: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return events.groupBy("congress").agg(kind("release_point").alias("release_points"), kind("public_law").alias("laws"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


@query(f"WITH {_ALL_EVENTS} SELECT congress, count(*) FILTER (event_type = 'release_point') AS release_points, count(*) FILTER (event_type = 'public_law') AS laws, min(event_date) AS first_date, max(event_date) AS last_date FROM e GROUP BY 1")
def timeline_summary_all(spark: SparkSession, d: str) -> DataFrame:
    """The summary over all customers as release points."""
    return _summary(_all_events(spark, d))


@query(f"WITH {_EVENTS} SELECT identifier FROM e WHERE event_type = 'public_law' AND (congress, law_number) NOT IN (SELECT 100 + CAST(c_custkey % 5 AS INTEGER), CAST(c_custkey % 1000 AS INTEGER) FROM customer WHERE c_acctbal < 0)")
def laws_not_deferred(spark: SparkSession, d: str) -> DataFrame:
    deferred = table(spark, d, "customer").where("c_acctbal < 0").select((F.col("c_custkey") % 5 + 100).cast("int").alias("congress"), (F.col("c_custkey") % 1000).cast("int").alias("law_number"))
    return relations.not_deferred(_events(spark, d).where("event_type = 'public_law'"), deferred).select("identifier")


@query("""SELECT user_id, n AS uses, a AS approved, r AS rejected, p AS pending, round(coalesce(CASE WHEN a + r > 0 THEN CAST(a AS DOUBLE) / (a + r) END, 0), 6) AS success_rate, n >= 10 AND coalesce(CASE WHEN a + r > 0 THEN CAST(a AS DOUBLE) / (a + r) END, 0) >= 0.5 AS eligible
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'error') AS r, count(*) FILTER (event_type = 'view') AS p FROM events GROUP BY 1)""")
def graduation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.graduation(table(spark, d, "events"), "user_id", "event_type", "click", "error", "view", rate=0.5)


@query("""WITH live AS (SELECT user_id, sum(CASE WHEN event_type <> 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS bad FROM events WHERE event_type <> 'view')
SELECT u.user_id, coalesce(s.streak, 0) AS streak FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(*) FILTER (bad = 0) AS streak FROM live GROUP BY 1) s USING (user_id)""")
def success_streak(spark: SparkSession, d: str) -> DataFrame:
    return intervals.streak(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], "event_type <> 'error'", "event_type = 'view'")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 10")
def having_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY 1, 2")
def zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return metrics.zero_filled(e.select("user_id", "event_type"), ["user_id"], "event_type", e)


@query("SELECT o_orderkey, coalesce(s.lines, 0) AS lines, coalesce(s.suppliers, 0) AS suppliers, coalesce(s.returned, 0) AS returned FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey")
def law_impact_view(spark: SparkSession, d: str) -> DataFrame:
    parts = {"lines": F.count(F.lit(1)), "suppliers": F.count_distinct("l_suppkey"), "returned": F.count_if(F.col("l_returnflag") == "R")}
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return metrics.impact(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", parts).fillna(0)


@query("""SELECT c_custkey, coalesce(a.orders, 0) AS orders, coalesce(b.parts, 0) AS parts FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) b ON b.o_custkey = c_custkey""")
def legislator_activity_safe(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    out = metrics.impact(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", {"orders": F.count(F.lit(1))})
    out = metrics.impact(out, lines, "c_custkey", {"parts": F.count(F.lit(1))})
    return out.select("c_custkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "parts")))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS laws, CAST(sum(n) AS BIGINT) AS changes, round(avg(n), 6) AS average, count(*) FILTER (n >= 8) AS omnibus FROM (SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) GROUP BY 1")
def productivity(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = metrics.impact(table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), lines, "o_orderkey", {"n": F.count(F.lit(1))})
    return metrics.productivity(rows.withColumn("n", F.coalesce("n", F.lit(0))), "year", "n", omnibus=8)


@query("SELECT user_id, event_type, n, rank, round(share, 6) AS share FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank, n / sum(n) OVER (PARTITION BY user_id) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE rank <= 2")
def focus_areas(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.shares(table(spark, d, "events"), ["user_id"], "event_type", 2)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT CASE WHEN n <= 5 THEN 'narrow' WHEN n <= 50 THEN 'moderate' ELSE 'broad' END AS scope, count(*) AS laws, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS largest, round(stddev_samp(n), 6) AS stddev FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def law_scope(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return metrics.scope_distribution(sizes, "n")


@query("SELECT user_id, round(sum(p * p), 6) AS specialization, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, n, n / sum(n) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1")
def specialization(spark: SparkSession, d: str) -> DataFrame:
    return metrics.specialization(table(spark, d, "events"), "user_id", "event_type")


_SPANS = "spans AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start_pos, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 600) AS BIGINT) + 1 AS end_pos FROM events)"
_UNION = """merged AS (SELECT user_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END AS new FROM (
      SELECT *, max(end_pos) OVER (PARTITION BY user_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans))) GROUP BY user_id, island)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long")
    return table(spark, d, "events").select("user_id", start.alias("start_pos"), (start + F.floor(F.col("value") * 600) + 1).alias("end_pos"))


@query(f"WITH {_SPANS}, {_UNION} SELECT * FROM merged")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union(_spans(spark, d), ["user_id"])


@query(f"WITH {_SPANS}, {_UNION} SELECT * FROM (SELECT user_id, lag(end_pos) OVER (PARTITION BY user_id ORDER BY start_pos) AS gap_start, start_pos AS gap_end FROM merged) WHERE gap_start IS NOT NULL")
def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(intervals.union(_spans(spark, d), ["user_id"]), ["user_id"])


@query("""WITH f AS (SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%'), w AS (SELECT doc_id FROM labels WHERE quality = 1), n AS (
  SELECT (SELECT count(*) FROM f WHERE doc_id IN (SELECT doc_id FROM w)) AS matched, (SELECT count(*) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM w)) AS only_found, (SELECT count(*) FROM w WHERE doc_id NOT IN (SELECT doc_id FROM f)) AS only_wanted)
SELECT *, coalesce(CASE WHEN matched + only_found > 0 THEN CAST(matched AS DOUBLE) / (matched + only_found) END, 0) AS "precision", coalesce(CASE WHEN matched + only_wanted > 0 THEN CAST(matched AS DOUBLE) / (matched + only_wanted) END, 0) AS recall FROM n""")
def crossref_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    found = search_sections(spark, d)
    return compare.precision_recall(found, table(spark, d, "labels").where("quality = 1"), ["doc_id"])


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def vote_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[0-9]+'))), ',') AS numbers FROM documents")
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[0-9]+"), F.lit(0))))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("numbers"))


_UPSERT = "WITH n AS (SELECT c_custkey + 100 AS c_custkey, 'new ' || c_name AS c_name FROM customer)"


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c, c.select((F.col("c_custkey") + 100).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"))


@query(f"{_UPSERT} SELECT c_custkey, coalesce(n.c_name, c.c_name) AS c_name FROM (SELECT c_custkey, c_name FROM customer) c FULL OUTER JOIN n USING (c_custkey)")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return relations.upsert(*_customers(spark, d), ["c_custkey"])


@query(f"{_UPSERT} SELECT c_custkey, coalesce(c.c_name, n.c_name) AS c_name FROM (SELECT c_custkey, c_name FROM customer) c FULL OUTER JOIN n USING (c_custkey)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    return relations.upsert(*_customers(spark, d), ["c_custkey"], update=False)


@query(f"{_UPSERT} SELECT n.c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'created' WHEN c.c_name IS NOT DISTINCT FROM n.c_name THEN 'skipped' ELSE 'updated' END AS outcome FROM n LEFT JOIN customer c ON c.c_custkey = n.c_custkey")
def upsert_outcome(spark: SparkSession, d: str) -> DataFrame:
    old, new = _customers(spark, d)
    return relations.upsert_outcome(old, new, ["c_custkey"], "c_name").select("c_custkey", "outcome")


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '\\(([0-9]{1,3}|[A-Za-z]{1,5})\\)', 1), ',') AS markers FROM documents")
def extract_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.markers(F.col("text")), ",").alias("markers"))


@query("SELECT doc_id, CAST(regexp_extract(text, '([0-9]+)\\s*[-–]\\s*([0-9]+)', 1) AS VARCHAR) AS yeas, CAST(regexp_extract(text, '([0-9]+)\\s*[-–]\\s*([0-9]+)', 2) AS VARCHAR) AS nays FROM documents")
def numeric_pairs(spark: SparkSession, d: str) -> DataFrame:
    pair = "([0-9]+)\\s*[-–]\\s*([0-9]+)"
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", pair, 1).alias("yeas"), F.regexp_extract("text", pair, 2).alias("nays"))


@query("SELECT doc_id, sha256(text) AS text_hash, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS plain_hash FROM documents")
def text_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.digest(F.col("text")).alias("text_hash"), text.digest(text.collapsed(F.col("text"))).alias("plain_hash"))


@query("SELECT o_orderkey, CAST(floor((year(o_orderdate) - CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) < 3 THEN 1 ELSE 0 END - 1789) / 2) AS INTEGER) + 1 AS congress FROM orders")
def order_congress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.congress_of(F.to_date("o_orderdate")).alias("congress"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS line_number, trim(line) AS content FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations) WHERE trim(line) <> ''")
def normalize_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = apply.lines_of(table(spark, d, "conversations"), ["conv_id", "turn"], "text")
    return rows.select("conv_id", "turn", F.col("line_number").cast("long").alias("line_number"), "content")


@query("SELECT o_orderkey, o_custkey, version, superseded FROM (SELECT o_orderkey, o_custkey, row_number() OVER w AS version, lead(o_orderdate) OVER w AS superseded FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))")
def version_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshots.closed_versions(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", F.col("version").cast("long").alias("version"), F.col("superseded_date").alias("superseded"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def owners_per_region(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return rows.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query()
def line_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation against the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("old"), F.col("text").alias("new"))
    return apply.line_hunks(rows, ["conv_id", "turn"], "old", "new")


@query("""WITH w AS (SELECT doc_id, text, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM documents),
l AS (SELECT doc_id, ws[1] AS old, ws[2] AS new, 32 + length(CAST(doc_id AS VARCHAR)) AS b, 'by striking "' || ws[1] || '" and inserting "' || ws[2] || '"' AS said, text FROM w WHERE len(ws) > 1),
t AS (SELECT *, 'Section ' || doc_id || ' of title 17 is amended ' || said || '. ' || text AS law, b + length(said) AS e FROM l)
SELECT doc_id AS law_id, 'strike_insert' AS pattern_name, 'Modify' AS change_type, 17 AS title_number, CAST(doc_id AS VARCHAR) AS section_number, CAST(NULL AS VARCHAR) AS subsection_path, old AS old_text, new AS new_text, CAST(0.9975 AS DOUBLE) AS confidence,
  CAST(b AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, false AS needs_review, substr(law, greatest(b - 100, 0) + 1, e + 100 - greatest(b - 100, 0)) AS context FROM t""")
def extracted_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits in documents, each turned into an instruction by its own first words."""
    docs = table(spark, d, "documents")
    words = F.split(text.collapsed(F.col("text")), " ")
    law = F.concat(F.lit("Section "), F.col("doc_id").cast("string"), F.lit(" of title 17 is amended by striking \""), words[0], F.lit("\" and inserting \""), F.get(words, F.lit(1)), F.lit("\". "), F.col("text"))
    return extract.extract_edits(docs.select(F.col("doc_id").alias("law_id"), F.coalesce(law, F.col("text")).alias("text")))


@query("""WITH w AS (SELECT doc_id, text, string_split_regex(trim(text), '\\s+')[1] AS old FROM documents),
m AS (SELECT doc_id, text, text IS NOT NULL AND trim(old) <> '' AS ok, CASE WHEN text IS NOT NULL AND trim(old) <> '' THEN substr(text, 1, strpos(text, old) - 1) || 'Amended' || substr(text, strpos(text, old) + length(old)) ELSE text END AS t FROM w)
SELECT doc_id AS title_number, '1' AS section_number, CASE WHEN doc_id % 5 > 0 THEN t END AS text_content, doc_id % 5 = 0 AS is_deleted, CAST(ok AS BIGINT) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS applied, CAST(0 AS BIGINT) AS skipped, 1 - CAST(ok AS BIGINT) AS failed, CASE WHEN doc_id % 5 > 0 THEN sha256(t) END AS text_hash FROM m""")
def applied_changes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sections; each one's first word is replaced, and every fifth is repealed."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("title_number"), F.lit("1").alias("section_number"), F.col("text").alias("text_content"))
    first = F.split(F.trim("text_content"), r"\s+")[0]
    modify = docs.select(*KEY, F.lit(1).cast("long").alias("change_id"), F.lit("Modify").alias("change_type"), first.alias("old_text"), F.lit("Amended").alias("new_text"))
    repeal = docs.where("title_number % 5 = 0").select(*KEY, F.lit(2).cast("long").alias("change_id"), F.lit("Repeal").alias("change_type"), F.lit(None).cast("string").alias("old_text"), F.lit(None).cast("string").alias("new_text"))
    return apply.apply_changes(docs, modify.unionByName(repeal))


@query(f"{_cte()}, l AS (SELECT s.*, c.chain_pos FROM snapshots s JOIN chain c USING (revision_id)) SELECT title_number, count(DISTINCT section_number) AS sections, min(revision_id) AS first_revision, max(revision_id) AS last_revision, count(*) FILTER (is_deleted) AS tombstones FROM l GROUP BY 1")
def title_blame_summary(spark: SparkSession, d: str) -> DataFrame:
    chain = snapshots.revision_chain(standins.revisions(spark, d), HEAD)
    rows = standins.snapshots(spark, d).join(chain, "revision_id")
    return rows.groupBy("title_number").agg(F.count_distinct("section_number").alias("sections"), F.min("revision_id").alias("first_revision"), F.max("revision_id").alias("last_revision"), F.count_if("is_deleted").alias("tombstones"))


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_custkey % 7 = 3 ORDER BY o_orderdate DESC, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) DESC, o_orderkey LIMIT 20 OFFSET 40")
def laws_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of laws, newest first, then by the number in their text."""
    number = F.substring("o_orderpriority", 1, 1).try_cast("int")
    rows, _ = relations.page(table(spark, d, "orders").where("o_custkey % 7 = 3"), [F.desc("o_orderdate"), number.desc(), "o_orderkey"], 20, 40)
    return rows.select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY o_orderdate DESC, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) DESC, o_orderkey LIMIT 20 OFFSET 40")
def laws_page_all(spark: SparkSession, d: str) -> DataFrame:
    """The third page of all laws."""
    number = F.substring("o_orderpriority", 1, 1).try_cast("int")
    rows, _ = relations.page(table(spark, d, "orders"), [F.desc("o_orderdate"), number.desc(), "o_orderkey"], 20, 40)
    return rows.select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%econ%') AND p_size = 11")
def search_laws(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").where("p_size = 11")
    return rows.where(relations.contains(F.col("p_name"), "red") | relations.contains(F.col("p_type"), "econ")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def head_revision(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Ingested").otherwise("Pending")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("sequence_number"), status.alias("status"))
    return snapshots.head_revision(rows).select(F.col("revision_id").alias("o_orderkey"), F.col("sequence_number").alias("o_orderdate"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 5000 AND o_orderstatus <> 'F' ORDER BY o_orderkey DESC LIMIT 1")
def last_derived_revision(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_orderkey").alias("sequence_number"), (F.col("o_orderstatus") == "F").alias("is_ground_truth"))
    return snapshots.last_derived_before(rows, 5000).select(F.col("revision_id").alias("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F') AND o_orderstatus <> 'F' ORDER BY o_orderkey DESC LIMIT 1")
def last_derived_revision_all(spark: SparkSession, d: str) -> DataFrame:
    """The last derived revision before the newest ground truth."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_orderkey").alias("sequence_number"), (F.col("o_orderstatus") == "F").alias("is_ground_truth"))
    bound = rows.where("is_ground_truth").agg(F.max("sequence_number")).first()[0]
    return snapshots.last_derived_before(rows, F.lit(bound).cast("long")).select(F.col("revision_id").alias("o_orderkey"))


@query("SELECT user_id, event_id, next_id FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events) WHERE next_id IS NOT NULL")
def consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.lead("event_id").over(w).alias("next_id")).where("next_id is not null")


@query("SELECT o_custkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def current_term(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max_by(F.struct("o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(newest.alias("s")).select("o_custkey", "s.*")


@query("SELECT user_id, min(event_id) FILTER (event_type = 'click') AS first_click, min(event_id) FILTER (event_type = 'purchase') AS first_purchase, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def milestones(spark: SparkSession, d: str) -> DataFrame:
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("event_id")))
    return table(spark, d, "events").groupBy("user_id").agg(first("click").alias("first_click"), first("purchase").alias("first_purchase"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, max(ts) AS latest, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 20 AND count(*) FILTER (event_type = 'purchase') >= 1")
def verification_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with enough verifications, one of the required kind at least."""
    out = table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    return out.where("n >= 20 and p >= 1").drop("p")


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value < 5) AS needs_review, count(*) FILTER (value >= 90) AS sure, round(avg(value), 3) AS average FROM events GROUP BY 1")
def amendment_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") < 5).alias("needs_review"), F.count_if(F.col("value") >= 90).alias("sure"), F.round(F.avg("value"), 3).alias("average"))


@query("SELECT user_id, sum(n)::BIGINT AS edits, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS by_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def ingestion_report(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string")))
    return counts.groupBy("user_id").agg(F.sum("n").alias("edits"), F.array_join(pairs, ";").alias("by_type"))


@query("SELECT l_orderkey AS law_id, count(*) FILTER (l_returnflag = 'A') AS added, count(*) FILTER (l_returnflag = 'N') AS modified, count(*) FILTER (l_returnflag = 'R') AS repealed FROM lineitem GROUP BY 1")
def law_counters(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "Add").when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "F", "Modify").otherwise("Delete")).otherwise("Repeal")
    return metrics.counters(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("law_id"), kind.alias("change_type")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT o_orderkey + 1000000, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3")
def replaced_children(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    parents = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    new = rows.join(parents, "o_custkey", "left_semi").select((F.col("o_orderkey") + 1000000).alias("o_orderkey"), "o_custkey")
    return relations.replace_children(rows, new, ["o_custkey"])


@query("SELECT CASE WHEN c_custkey IS NULL THEN 'rejected' ELSE 'inserted' END AS outcome, count(*) AS votes FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey GROUP BY 1")
def votes_with_rejects(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    known, unknown = relations.split_known(table(spark, d, "orders"), members, ["o_custkey"])
    return known.select(F.lit("inserted").alias("outcome")).unionByName(unknown.select(F.lit("rejected").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("votes"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def keys_in_both(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return a.intersect(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def keys_in_first(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return a.subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


_COVER = f"WITH {_SPANS}, {_UNION}"


@query(f"{_COVER} SELECT user_id, CAST(sum(end_pos - start_pos) AS BIGINT) AS covered, 2592000 AS total, round(sum(end_pos - start_pos) * 100.0 / 2592000, 1) AS coverage FROM merged GROUP BY 1")
def span_coverage(spark: SparkSession, d: str) -> DataFrame:
    merged = intervals.union(_spans(spark, d), ["user_id"]).withColumn("total", F.lit(2592000))
    out = intervals.covered(merged, ["user_id"], "total")
    return out.withColumn("coverage", F.round(F.col("covered") * 100.0 / F.col("total"), 1))


@query("SELECT a.event_id AS a, b.event_id AS b FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) + 1 AS e FROM events WHERE event_type = 'click') a JOIN (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) + 1 AS e FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e")
def overlapping_spans(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long")
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id", start.alias("start_pos"), (start + F.floor(F.col("value") * 60) + 1).alias("end_pos"))
    pick = lambda k: rows.where(F.col("event_type") == k).select("user_id", "event_id", "start_pos", "end_pos")
    return intervals.overlapping(pick("click"), pick("error"), ["user_id"], width=3600).select(F.col("event_id").alias("a"), F.col("event_id_b").alias("b"))


@query("SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def collaboration_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of one order as co-sponsors of one law; an order has few lines, which bounds its pairs."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("a"))
    return metrics.shared_pairs(lines, "l_orderkey", "a")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(DISTINCT o_orderkey) AS laws, round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))), 4) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def days_to_passage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count_distinct("o_orderkey").alias("laws"), F.round(F.avg(F.datediff("l_shipdate", "o_orderdate")), 4).alias("days"))


@query("SELECT user_id, event_type, count(*) AS changes, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS stable_days FROM events GROUP BY 1, 2")
def section_stability(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.lit("2024-02-01").cast("date"), F.max("ts")).cast("long")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("changes"), days.alias("stable_days"))


@query("SELECT conv_id, count(*) AS turns, max(length(text)) AS longest, count(DISTINCT role) AS roles, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1")
def line_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max(F.length("text")).cast("long").alias("longest"), F.count_distinct("role").alias("roles"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("SELECT n_name, c_custkey, c_acctbal FROM (SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE rn <= 3")
def top_contributors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("n_name", "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'p' THEN 'Yea' WHEN 'f' THEN 'Nay' ELSE 'Not_Voting' END AS position FROM orders")
def vote_positions(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("o_orderstatus") == "P", " Aye ").when(F.col("o_orderstatus") == "F", "NO").otherwise("absent")
    return table(spark, d, "orders").select("o_orderkey", text.vote_position(said).alias("position"))


@query(f"WITH {_EVENTS} SELECT identifier, CASE WHEN event_date IS NULL THEN false ELSE year(event_date) BETWEEN 1789 + (congress - 1) * 2 - 1 AND 1789 + (congress - 1) * 2 + 2 END AS plausible FROM e")
def plausible_dates(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("identifier", F.coalesce(dates.plausible_year(F.year("event_date"), F.col("congress")), F.lit(False)).alias("plausible"))


@query(f"WITH {_ALL_EVENTS} SELECT identifier, CASE WHEN event_date IS NULL THEN false ELSE year(event_date) BETWEEN 1789 + (congress - 1) * 2 - 1 AND 1789 + (congress - 1) * 2 + 2 END AS plausible FROM e")
def plausible_dates_all(spark: SparkSession, d: str) -> DataFrame:
    """The report over all customers as release points."""
    return _all_events(spark, d).select("identifier", F.coalesce(dates.plausible_year(F.year("event_date"), F.col("congress")), F.lit(False)).alias("plausible"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS short, translate(source, 'src', 'SRC') AS source FROM documents")
def short_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.shortened(F.col("text")).alias("short"), F.translate("source", "src", "SRC").alias("source"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('error', 'view')) WHERE rn = 1")
def latest_votes_per_chamber(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where(F.col("event_type").isin("error", "view"))
    newest = F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id"))
    return rows.groupBy("user_id", "event_type").agg(newest.alias("s")).select("user_id", "s.*")


@query("""SELECT p_partkey AS law_id, 'Modify' AS change_type, 26 AS title_number, CAST(p_size AS VARCHAR) AS section_number, '(c)' AS subsection_path, p_type AS old_text, p_name AS new_text, round(0.98, 6) AS confidence FROM part""")
def xml_instructions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as amending instructions in XML: strike the type, insert the name."""
    xml = F.format_string(
        '<law xmlns="http://schemas.gpo.gov/xml/uslm"><section role="instruction"><chapeau>Section <ref href="/us/usc/t26/s%s/c"/> is <amendingAction type="amend">amended</amendingAction></chapeau>'
        '<paragraph>by <amendingAction type="delete">striking</amendingAction> <quotedText>%s</quotedText> and <amendingAction type="insert">inserting</amendingAction> <quotedText>%s</quotedText>.</paragraph></section></law>',
        F.col("p_size").cast("string"), F.col("p_type"), F.col("p_name"),
    )
    out = xml_edits.extract_xml_edits(table(spark, d, "part").select(F.col("p_partkey").alias("law_id"), xml.alias("xml")))
    return out.select("law_id", "change_type", "title_number", "section_number", "subsection_path", "old_text", "new_text", F.round("confidence", 6).alias("confidence"))


@query("SELECT p_partkey, '(a) ' || p_name || chr(10) || '(b) changed' || chr(10) || '(c) ' || p_brand AS text_content, 3 AS lines FROM part")
def patched_sections(spark: SparkSession, d: str) -> DataFrame:
    """Parts as sections of two lines: the type is replaced, and a line (c) goes in after (b)."""
    part = table(spark, d, "part")
    sections = part.select("p_partkey", F.concat(F.lit("(a) "), "p_name", F.lit("\n(b) "), "p_type").alias("text_content"))
    nothing = F.lit(None).cast("string")
    change = lambda i, kind, old, new: part.select("p_partkey", F.lit(i).alias("change_id"), F.lit(kind).alias("change_type"), old.alias("old_text"), new.alias("new_text"))
    changes = change(1, "Modify", F.concat(F.lit("(b) "), "p_type"), F.lit("(b) changed")).unionByName(change(2, "Add", nothing, F.concat(F.lit("(c) "), "p_brand")))
    return provisions.patch_sections(sections, changes, ["p_partkey"])


@query("""SELECT o_custkey, string_agg(role || o_orderkey, ',' ORDER BY framework DESC, o_orderdate, o_orderkey) AS citations, max(CASE WHEN role <> 'F' THEN year(o_orderdate) END) AS last_modified FROM (
  SELECT *, CASE WHEN framework THEN 'F' WHEN row_number() OVER (PARTITION BY o_custkey, framework ORDER BY o_orderdate, o_orderkey) = 1 THEN 'E' ELSE 'A' END AS role
  FROM (SELECT *, o_orderstatus = 'P' AS framework FROM orders)) GROUP BY 1""")
def citation_roles(spark: SparkSession, d: str) -> DataFrame:
    """Orders as citations of customers: those of status P are acts, the others laws."""
    one = F.struct("o_orderdate", "o_orderkey", (F.col("o_orderstatus") == "P").alias("is_act"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("c"))
    plain = F.transform("c", lambda c: F.struct(c["o_orderkey"].cast("string").alias("law"), c["is_act"].alias("is_act"), F.year(c["o_orderdate"]).alias("year")))
    rows = rows.withColumn("c", provisions.ordered_citations(plain))
    said = F.array_join(F.transform("c", lambda c: F.concat(F.substring(c["role"], 1, 1), c["law"])), ",")
    return rows.select("o_custkey", said.alias("citations"), provisions.last_modified(F.col("c")).cast("long").alias("last_modified"))


from . import law_queries  # noqa: E402, F401  registers its queries
from . import text_queries  # noqa: E402, F401  registers its queries
