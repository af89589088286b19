"""Queries of linked references, trees of lines, edits at anchors and what lines go back to, over the driver's tables in these roles.

Shapes vary with the keys; the SQL gives the results from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import anchored, apply, blame, extract, line_tree, links, records, spans, xml_edits
from ..operators.lineage import spread
from ..sources import uslm
from ..sources.tables import table
from ..streaming import live
from .law_queries import said
from .queries import query

# Linked references


def _masked(inner: str, n: int) -> str:
    """The text with the n-th name, in the order in which names are linked, as a character of its own."""
    return f"CASE WHEN n[{n}].name IS NOT NULL THEN replace({inner}, n[{n}].name, chr({57344 + n})) ELSE {inner} END"


def _restored(inner: str, n: int) -> str:
    return f"CASE WHEN n[{n}].name IS NOT NULL THEN replace({inner}, chr({57344 + n}), CASE WHEN n[{n}].href IS NULL THEN n[{n}].name ELSE '[' || n[{n}].name || '](' || n[{n}].href || ')' END) ELSE {inner} END"


_N_LINKS = " + ".join(f"CASE WHEN n[{k}].href IS NOT NULL THEN length(m4) - length(replace(m4, chr({57344 + k}), '')) ELSE 0 END" for k in range(1, 5))


@query(f"""WITH w AS (SELECT doc_id, text, string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents WHERE text IS NOT NULL AND text <> ''),
r AS (
  SELECT doc_id, text, list_filter([
    {{'at': 0, 'name': w[1], 'href': '/sections/17/' || doc_id || '?rev=' || doc_id % 7}}, {{'at': 1, 'name': w[1] || ' ' || w[2], 'href': '/laws/' || (95 + doc_id % 20) || '/' || (doc_id + 1) || '?rev=' || doc_id % 7}},
    {{'at': 2, 'name': w[2] || ' ' || w[3] || ' ' || w[4], 'href': NULL}}, {{'at': 3, 'name': w[3], 'href': CASE WHEN doc_id % 3 > 0 THEN '/sections/5/' || w[3] || '?rev=' || doc_id % 7 END}}
  ], lambda x: x.name IS NOT NULL AND x.name <> '') AS n FROM w
),
s AS (SELECT doc_id, text, list_transform(list_sort(list_transform(n, lambda x: {{'k': -length(x.name), 'at': x.at, 'name': x.name, 'href': x.href}})), lambda x: {{'name': x.name, 'href': x.href}}) AS n FROM r),
m1 AS (SELECT *, {_masked("text", 1)} AS m1 FROM s), m2 AS (SELECT *, {_masked("m1", 2)} AS m2 FROM m1), m3 AS (SELECT *, {_masked("m2", 3)} AS m3 FROM m2), m4 AS (SELECT *, {_masked("m3", 4)} AS m4 FROM m3),
b1 AS (SELECT *, {_restored("m4", 1)} AS b1 FROM m4), b2 AS (SELECT *, {_restored("b1", 2)} AS b2 FROM b1), b3 AS (SELECT *, {_restored("b2", 3)} AS b3 FROM b2)
SELECT doc_id, CAST({_N_LINKS} AS BIGINT) AS links, sha256({_restored("b3", 4)}) AS linked_sha256 FROM b3""")
def linked_references(spark: SparkSession, d: str) -> DataFrame:
    """Names out of each document's own first words, which overlap, linked wherever they stand in it."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    w = F.split(F.regexp_replace("text", r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""), r"[ \t\n\x0B\f\r]+")
    word = lambda k: F.get("_w", F.lit(k - 1))
    null = lambda t: F.lit(None).cast(t)
    ref = lambda at, name, kind, title=null("int"), section=null("string"), congress=null("int"), law=null("long"), ok=F.lit(True): F.struct(
        F.lit(at).alias("position"), name.alias("display_text"), F.lit(kind).alias("ref_type"), F.lit(f"/us/{at}").alias("target_id"), title.alias("usc_title"), section.alias("usc_section"),
        congress.alias("congress"), law.alias("law_number"), ok.alias("resolvable"),
    )
    k = F.col("doc_id")
    listed = F.array(
        ref(0, word(1), "usc_section", title=F.lit(17), section=k.cast("string")), ref(1, said(word(1), " ", word(2)), "public_law", congress=(k % 20 + 95).cast("int"), law=k + 1),
        ref(2, said(word(2), " ", word(3), " ", word(4)), "act"), ref(3, word(3), "usc_section", title=F.lit(5), section=word(3), ok=k % 3 > 0),
    )
    references = spread(docs).select("doc_id", w.alias("_w")).select("doc_id", F.explode(listed).alias("r")).select("doc_id", "r.*")
    cut = links.linked_pieces(docs, references, ["doc_id"], revision=None)
    # The revision goes into every link.
    cut = cut.withColumn("href", F.concat("href", F.lit("?rev="), (k % 7).cast("string")))
    return links.linked_text(cut, ["doc_id"]).select("doc_id", "links", F.sha2("linked_text", 256).alias("linked_sha256"))


# Trees of lines: customers as sections, their orders as lines

_LINES = "lines AS (SELECT o_custkey AS section, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS line_number, CAST((o_orderkey * 7 + o_custkey) % 11 % 5 AS INTEGER) AS indent_level, '(' || o_orderkey % 9 || ')' AS marker FROM orders)"
_TREE = f"""{_LINES},
up AS (SELECT a.section, a.line_number, a.indent_level, a.marker, max(b.line_number) AS parent FROM lines a LEFT JOIN lines b ON b.section = a.section AND b.line_number < a.line_number AND b.indent_level < a.indent_level GROUP BY ALL)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = table(spark, d, "orders")
    return orders.select(F.col("o_custkey").alias("section"), number.alias("line_number"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 11 % 5).cast("int").alias("indent_level"), said("(", F.col("o_orderkey") % 9, ")").alias("marker"))


@query(f"""WITH RECURSIVE {_TREE},
down AS (SELECT section, line_number AS root, line_number FROM up UNION ALL SELECT d.section, d.root, u.line_number FROM down d JOIN up u ON u.section = d.section AND u.parent = d.line_number),
last AS (SELECT section, root, max(line_number) AS last, count(*) - 1 AS below FROM down GROUP BY 1, 2),
way AS (SELECT section, line_number, marker AS path, 0 AS depth FROM up WHERE parent IS NULL UNION ALL SELECT u.section, u.line_number, w.path || u.marker, w.depth + 1 FROM way w JOIN up u ON u.section = w.section AND u.parent = w.line_number)
SELECT u.section, u.line_number, u.indent_level, u.marker, u.parent, CAST(l.last AS INTEGER) AS last, CAST(l.last - u.line_number AS INTEGER) AS below, w.depth, w.path FROM up u JOIN last l ON l.section = u.section AND l.root = u.line_number JOIN way w ON w.section = u.section AND w.line_number = u.line_number""")
def line_trees(spark: SparkSession, d: str) -> DataFrame:
    """Parents, ranges, depths and paths of lines."""
    return line_tree.with_tree(_lines(spark, d), ["section"], marker="marker").withColumn("below", F.col("last") - F.col("line_number"))


@query(f"""WITH RECURSIVE {_TREE},
down AS (SELECT section, line_number AS root, line_number FROM up WHERE line_number % 3 = 1 UNION ALL SELECT d.section, d.root, u.line_number FROM down d JOIN up u ON u.section = d.section AND u.parent = d.line_number)
SELECT section, root, line_number FROM down""")
def line_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """The subtree of every third line, by its range of line numbers."""
    tree = line_tree.with_tree(_lines(spark, d), ["section"])
    return line_tree.subtrees(tree, tree.where("line_number % 3 = 1"), ["section"]).select("section", "root", "line_number")


@query(f"""WITH RECURSIVE {_TREE},
way AS (SELECT section, line_number AS below, line_number, parent FROM up WHERE line_number % 4 = 0 UNION ALL SELECT w.section, w.below, u.line_number, u.parent FROM way w JOIN up u ON u.section = w.section AND u.line_number = w.parent)
SELECT section, below, line_number FROM way""")
def line_paths(spark: SparkSession, d: str) -> DataFrame:
    """The way from every fourth line to its root, by the ranges that hold it."""
    tree = line_tree.with_tree(_lines(spark, d), ["section"])
    return line_tree.paths(tree, tree.where("line_number % 4 = 0"), ["section"]).select("section", "below", "line_number")


@query(f"""WITH RECURSIVE {_TREE},
way AS (SELECT section, line_number, marker, 0 AS depth FROM up WHERE parent IS NULL UNION ALL SELECT u.section, u.line_number, u.marker, w.depth + 1 FROM way w JOIN up u ON u.section = w.section AND u.parent = w.line_number),
k AS (SELECT section, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds FROM (SELECT section, CASE WHEN marker IN ('(0)', '(1)') THEN 'header' ELSE 'item' END AS kind, count(*) AS n FROM way GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT section, CAST(sum(n) AS BIGINT) AS lines, max(depth) AS max_depth, string_agg(depth || ':' || n, ',' ORDER BY depth) AS depths FROM (SELECT section, depth, count(*) AS n FROM way GROUP BY 1, 2) GROUP BY 1)
SELECT section, lines, max_depth, depths, kinds FROM p JOIN k USING (section)""")
def line_tree_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many lines sections have, how deep they go, and of what kind they are."""
    tree = line_tree.with_tree(_lines(spark, d), ["section"])
    kind = F.when(F.col("marker").isin("(0)", "(1)"), "header").otherwise("item")
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return line_tree.tree_stats(tree, ["section"], kind).select("section", "lines", "max_depth", shown("by_depth").alias("depths"), shown("by_kind").alias("kinds"))


_K = "k AS (SELECT o_orderkey AS k, o_orderkey % 3 AS h, o_orderkey % 2 AS c, o_orderkey % 5 AS e FROM orders)"


@query(f"""WITH {_K},
l AS (
  SELECT k, 10 AS pos, CASE WHEN h = 0 THEN '(a) In general ' || k ELSE '(a) It holds for ' || k || '.' END AS content, 0 AS indent_level, '(a)' AS marker, h = 0 AS is_header FROM k
  UNION ALL SELECT k, 11, 'It holds for ' || k || '.', 1, NULL, false FROM k WHERE h = 0
  UNION ALL SELECT k, 12, 'See Pub. L. 9–' || k || ' too.', 1, NULL, false FROM k WHERE c = 1
  UNION ALL SELECT k, 20, '(1) first', CASE WHEN h = 0 THEN 2 ELSE 1 END, '(1)', false FROM k
  UNION ALL SELECT k, 21, '(2)', CASE WHEN h = 0 THEN 2 ELSE 1 END, '(2)', false FROM k WHERE e = 0
  UNION ALL SELECT k, 30, 'And ' || k || ' closes it.', 0, NULL, false FROM k WHERE e = 1
  UNION ALL SELECT k, 31, 'So does this.', 0, NULL, false FROM k WHERE e = 1
  UNION ALL SELECT k, 40, '', 0, NULL, false FROM k
  UNION ALL SELECT k, 41, '(b) Part II Of ' || k, 0, '(b)', true FROM k
),
n AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS line_number, CAST(sum(length(content) + 1) OVER w AS INTEGER) AS end_char FROM l WINDOW w AS (PARTITION BY k ORDER BY pos))
SELECT n.k AS o_orderkey, n.line_number, n.content, n.indent_level, n.marker, n.is_header, CAST(n.end_char - length(n.content) - 1 AS INTEGER) AS start_char, n.end_char,
  max(b.line_number) FILTER (b.line_number < n.line_number AND b.indent_level < n.indent_level AND b.content <> '' AND n.content <> '') AS parent
FROM n JOIN n b ON b.k = n.k GROUP BY n.k, n.line_number, n.content, n.indent_level, n.marker, n.is_header, n.end_char""")
def structured_section_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of structured sections, with and without headings, second sentences, empty levels and closing words."""
    k = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    level = lambda depth, kind, marker, heading, content: F.struct(F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), (F.lit(marker) if marker else null).alias("marker"), heading.alias("heading"), content.alias("content"))
    first = F.concat(said("It holds for ", k, "."), F.when(k % 2 == 1, said(" See Pub. L. 9–", k, " too.")).otherwise(""))
    levels = F.array_compact(F.array(
        level(0, "level", "(a)", F.when(k % 3 == 0, said("In general ", k, ".—")), first), level(1, "level", "(1)", null, F.lit("first")), F.when(k % 5 == 0, level(1, "level", "(2)", null, null)),
        F.when(k % 5 == 1, level(0, "closing", None, null, said("And ", k, " closes it. So does this."))), level(0, "level", "(b)", said("PART II OF ", k), null),
    ))
    rows = table(spark, d, "orders").select("o_orderkey", levels.alias("levels"), null.alias("text_content"))
    out = line_tree.section_lines(rows, ["o_orderkey"], levels="levels")
    return out.select("o_orderkey", "line_number", "content", "indent_level", "marker", "is_header", "start_char", "end_char", "parent")


@query(f"""WITH {_K},
t AS (SELECT k, h, c, 'In this part, ' || k || ' counts. ' AS p, '(a) ' || CASE WHEN c = 0 THEN 'Rules—Each one is kept. So it is.' ELSE 'Each one is kept. So it is.' END || ' ' AS a, '(1) under subsection (b), or ' || k || '; ' AS b, '(A) alone' AS z FROM k),
l AS (
  SELECT k, 1 AS pos, 'In this part, ' || k || ' counts.' AS content, 0 AS lv, NULL AS marker, false AS is_header, 0 AS s, length(p) - 1 AS e FROM t WHERE h > 0
  UNION ALL SELECT k, 2, '(a) Rules', 1, '(a)', true, off, off + 9 FROM (SELECT *, CASE WHEN h > 0 THEN length(p) ELSE 0 END AS off FROM t) WHERE c = 0
  UNION ALL SELECT k, 3, 'Each one is kept. So it is.', 2, NULL, false, off + 10, off + 37 FROM (SELECT *, CASE WHEN h > 0 THEN length(p) ELSE 0 END AS off FROM t) WHERE c = 0
  UNION ALL SELECT k, 2, '(a) Each one is kept.', 1, '(a)', false, off, off + 21 FROM (SELECT *, CASE WHEN h > 0 THEN length(p) ELSE 0 END AS off FROM t) WHERE c = 1
  UNION ALL SELECT k, 3, 'So it is.', 2, NULL, false, off + 22, off + 31 FROM (SELECT *, CASE WHEN h > 0 THEN length(p) ELSE 0 END AS off FROM t) WHERE c = 1
  UNION ALL SELECT k, 4, trim(b), 2, '(1)', false, off, off + length(b) - 1 FROM (SELECT *, CASE WHEN h > 0 THEN length(p) ELSE 0 END + length(a) AS off FROM t)
  UNION ALL SELECT k, 5, z, 3, '(A)', false, off, off + length(z) FROM (SELECT *, CASE WHEN h > 0 THEN length(p) ELSE 0 END + length(a) + length(b) AS off FROM t)
)
SELECT k AS o_orderkey, CAST(row_number() OVER (PARTITION BY k ORDER BY pos) AS INTEGER) AS line_number, content, lv AS indent_level, marker, is_header, CAST(s AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char, CASE WHEN marker = '(a)' THEN '(a)' WHEN marker = '(1)' OR marker = '(A)' THEN '(a)(1)' || CASE WHEN marker = '(A)' THEN '(A)' ELSE '' END WHEN lv = 2 THEN '(a)' END AS path FROM l""")
def prose_section_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of sections that are prose, with headers, references that look like markers, and sentences."""
    k = F.col("o_orderkey")
    text = F.concat(F.when(k % 3 > 0, said("In this part, ", k, " counts. ")).otherwise(""), F.when(k % 2 == 0, "(a) Rules—Each one is kept. So it is. ").otherwise("(a) Each one is kept. So it is. "), said("(1) under subsection (b), or ", k, "; (A) alone"))
    out = line_tree.section_lines(table(spark, d, "orders").select("o_orderkey", text.alias("text_content")), ["o_orderkey"])
    return out.select("o_orderkey", "line_number", "content", "indent_level", "marker", "is_header", "start_char", "end_char", "path")


# Edits at anchors: parts as sections of four subsections

_PARTS = "p AS (SELECT p_partkey AS k, p_partkey % 7 AS v FROM part)"
_BASE = "b AS (SELECT k, v, n AS pos, '(' || m || ')' AS marker, '(' || m || ') text ' || m || ' of ' || k AS content, CAST(NULL AS BIGINT) AS created_by, CAST(NULL AS BIGINT) AS changed_by FROM p CROSS JOIN (VALUES (1.0, 'a'), (2.0, 'b'), (3.0, 'c'), (4.0, 'd')) x(n, m))"
_AFTER = f"""WITH {_PARTS}, {_BASE},
l AS (
  SELECT k, pos, marker, content, created_by, changed_by FROM b WHERE v = 0
  UNION ALL SELECT k, pos, marker, content, created_by, changed_by FROM b WHERE v = 1 UNION ALL SELECT k, 2.1, '(b)(1)', '(b)(1) new after b', 1, 1 FROM p WHERE v = 1 UNION ALL SELECT k, 2.2, NULL, 'and more', 1, 1 FROM p WHERE v = 1
  UNION ALL SELECT k, pos, CASE pos WHEN 3.0 THEN '(d)' WHEN 4.0 THEN '(e)' ELSE marker END, CASE pos WHEN 3.0 THEN '(d) text c of ' || k WHEN 4.0 THEN '(e) text d of ' || k ELSE content END, created_by, CASE WHEN pos > 2 THEN 1 END FROM b WHERE v = 2
  UNION ALL SELECT k, 2.5, '(c)', '(c) put between', 2, 2 FROM p WHERE v = 2
  UNION ALL SELECT k, pos, marker, content, created_by, changed_by FROM b WHERE v = 3 AND pos NOT IN (2.0, 3.0) UNION ALL SELECT k, 2.0, '(b)', '(b) instead', 1, 1 FROM p WHERE v = 3
  UNION ALL SELECT k, pos, marker, CASE WHEN pos = 1.0 THEN '(a) words of ' || k ELSE content END, created_by, CASE WHEN pos = 1.0 THEN 1 END FROM b WHERE v = 4
  UNION ALL SELECT k, pos, marker, content, created_by, changed_by FROM b WHERE v = 5 AND pos <> 3.0
  UNION ALL SELECT k, pos, marker, content, created_by, changed_by FROM b WHERE v = 6 UNION ALL SELECT k, 0.5, '(aa)', '(aa) before all', 1, 1 FROM p WHERE v = 6 UNION ALL SELECT k, 4.5, NULL, 'unmarked at the end', 2, 2 FROM p WHERE v = 6
)"""


def _anchored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, v = F.col("p_partkey"), F.col("p_partkey") % 7
    parts = table(spark, d, "part")
    lines = parts.select("p_partkey", F.posexplode(F.array(*map(F.lit, "abcd"))).alias("n", "m")).select("p_partkey", (F.col("n") + 1).alias("line_number"), said("(", F.col("m"), ")").alias("marker"), said("(", F.col("m"), ") text ", F.col("m"), " of ", k).alias("content"), F.lit(0).alias("indent_level"))
    null, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    change = lambda n, kind, old=null, new=null, position=null, anchor=null, marks=none, to=none, instruction=null: F.struct(
        F.lit(n).cast("long").alias("change_id"), F.lit(kind).alias("change_type"), old.alias("old_text"), new.alias("new_text"), position.alias("position"), anchor.alias("anchor"), marks.alias("old_markers"), to.alias("new_markers"), instruction.alias("instruction")
    )
    words = lambda *x: F.array(*map(F.lit, x))
    steps = (
        F.when(v == 1, F.array(change(1, "Add", new=F.lit("(b)(1) new after b\n\nand more"), position=F.lit("after"), anchor=F.lit("(b)"))))
        .when(v == 2, F.array(change(1, "Redesignate", marks=words("(c)", "(d)"), to=words("(d)", "(e)")), change(2, "Add", new=F.lit("(c) put between"))))
        .when(v == 3, F.array(change(1, "Modify", new=F.lit("(b) instead"), instruction=F.lit("by striking subsections (b) and (c) and inserting the following"))))
        .when(v == 4, F.array(change(1, "Modify", old=F.lit("TEXT  a"), new=F.lit("words")), change(2, "Modify", old=F.lit("nowhere"), new=F.lit("x"))))
        .when(v == 5, F.array(change(1, "Delete", marks=words("(c)"))))
        .when(v == 6, F.array(change(1, "Add", new=F.lit("(aa) before all"), position=F.lit("before"), anchor=F.lit("(a)")), change(2, "Add", new=F.lit("unmarked at the end"))))
    )
    changes = parts.select("p_partkey", F.explode(steps).alias("c")).select("p_partkey", "c.*")
    return anchored.apply_anchored(anchored.keyed(lines, ["p_partkey"]), changes, ["p_partkey"])


@query(f"{_AFTER} SELECT k AS p_partkey, CAST(row_number() OVER (PARTITION BY k ORDER BY pos) AS INTEGER) AS line_number, marker, content, CAST(created_by AS BIGINT) AS created_by, CAST(changed_by AS BIGINT) AS changed_by FROM l")
def anchored_edits(spark: SparkSession, d: str) -> DataFrame:
    """Lines after additions at anchors, redesignations, and subsections struck and replaced."""
    return _anchored(spark, d)[0].select("p_partkey", "line_number", "marker", "content", "created_by", "changed_by")


@query("SELECT p_partkey, CAST(n AS BIGINT) AS change_id, NOT (p_partkey % 7 = 4 AND n = 2) AS placed FROM part CROSS JOIN (VALUES (1), (2)) x(n) WHERE p_partkey % 7 IN (2, 4, 6) OR p_partkey % 7 IN (1, 3, 5) AND n = 1")
def anchored_changes(spark: SparkSession, d: str) -> DataFrame:
    """Which changes found their place."""
    return _anchored(spark, d)[1]


@query(f"""{_AFTER} SELECT k AS p_partkey, CAST(row_number() OVER (PARTITION BY k ORDER BY pos) AS INTEGER) AS line_number, 'Pub. L. 115–' || created_by AS created_law, 'Pub. L. 115–' || changed_by AS changed_law FROM l""")
def line_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The laws that made and last changed each line."""
    laws = spark.range(1, 3).select(F.col("id").alias("law_id"), said("Pub. L. 115–", F.col("id")).alias("law"))
    return anchored.provenance(_anchored(spark, d)[0], laws, ["p_partkey"]).select("p_partkey", "line_number", "created_law", "changed_law")


# Instructions in prose: each order is a law with one of these, its numbers in them

#: An instruction and the edits that it makes: (pattern, change, title, section, path, old text, new text). {k} is the order's key, {s} a section.
_S = "Section {s} of title 26, United States Code, is amended "
INSTRUCTIONS = (
    (_S + 'by striking "old {k}" and inserting "new {k}".', [("strike_insert", "Modify", "26", "{s}", None, "old {k}", "new {k}")]),
    (_S + 'by striking “the “inner” {k}” each place it appears and inserting “x{k}”.', [("strike_insert_each_place", "Modify", "26", "{s}", None, "the “inner” {k}", "x{k}")]),
    (_S + "by striking out ``{k} days'' and inserting in lieu thereof ``the lender's {k}''.", [("strike_insert", "Modify", "26", "{s}", None, "{k} days", "the lender's {k}")]),
    (_S + 'by striking the words "tax {k}" and inserting "plan {k}".', [("strike_insert_phrase", "Modify", "26", "{s}", None, "tax {k}", "plan {k}")]),
    (_S + 'by striking everything before "term {k}" and inserting "In part {k},".', [("strike_insert_everything_before", "Modify", "26", "{s}", None, "term {k}", "In part {k},")]),
    (_S + 'by striking all that follows "Secretary {k}" and inserting a period.', [("strike_insert_everything_after", "Modify", "26", "{s}", None, "Secretary {k}", None)]),
    (_S + 'by striking "a {k}", "b", and "c".', [("strike", "Delete", "26", "{s}", None, x, None) for x in ("a {k}", "b", "c")]),
    (_S + 'by striking "unless {k}" and all that follows through the semicolon.', [("strike_through_period", "Delete", "26", "{s}", None, "unless {k}", None)]),
    (_S + 'by striking "but {k}" and everything that follows.', [("strike_and_following", "Delete", "26", "{s}", None, "but {k}", None)]),
    ("Section {s}(c) of title 26 is amended by striking paragraphs (4), (5), and (6).", [("strike_paragraph", "Delete", "26", "{s}", f"(c)({n})", None, None) for n in (4, 5, 6)]),
    (_S + "by adding at the end thereof the following new subsection: ``(h) New {k}.''", [("add_at_end", "Add", "26", "{s}", None, None, "(h) New {k}.")]),
    (_S + "by inserting after paragraph (8) the following: \"(9) {k}\".", [("add_after_paragraph", "Add", "26", "{s}", "(8)", None, "(9) {k}")]),
    (_S + "by inserting before clause (ii) the following new clause.", [("insert_before_paragraph", "Add", "26", "{s}", "(ii)", None, None)]),
    (_S + 'by inserting before "date {k}" the following: "earlier {k}".', [("insert_before", "Add", "26", "{s}", None, None, "earlier {k}")]),
    (_S + 'by inserting after "date {k}" "later {k}".', [("insert_after", "Add", "26", "{s}", None, None, "later {k}")]),
    (_S + "by adding new paragraph (9) as follows: “{k} it is”.", [("add_new_subsection", "Add", "26", "{s}", "(9)", None, "{k} it is")]),
    ("Section {s}(b)(2) of title 5 is hereby repealed, by order {k}.", [("repeal", "Repeal", "5", "{s}", "(b)(2)", None, None)]),
    ("Sections 7, 9, and {k}a of title 5 are repealed.", [("repeal", "Repeal", "5", x, None, None, None) for x in ("7", "9", "{k}a")]),
    ("Sections 106 through 108 of title 17 are repealed ({k}).", [("repeal", "Repeal", "17", x, None, None, None) for x in ("106", "107", "108")]),
    ("Paragraph (3) of section {s}(a) of title 9 is hereby stricken, {k}.", [("paragraph_repealed", "Repeal", "9", "{s}", "(a)(3)", None, None)]),
    (_S + "by redesignating section 45R as section 45S{k}.", [("redesignate_section", "Redesignate", "26", "45R", None, "45R", "45S{k}")]),
    (_S + "by redesignating clauses (i), (ii), and (iii) as clauses (ii), (iii), and (iv) of {k}.", [("redesignate_paragraph", "Redesignate", "26", "{s}", None, "(i), (ii), and (iii)", "(ii), (iii), and (iv)")]),
    ('Section {s} of title 11 is amended and reenacted to read as follows: "It reads {k}."', [("substitute_section", "Modify", "11", "{s}", None, None, "It reads {k}.")]),
    ('Subsection (d) of section {s} of title 11 is amended to read as follows: "{k} it reads"', [("substitute_subsection", "Modify", "11", "{s}", "(d)", None, "{k} it reads")]),
    ("Section {s} of title 18 is transferred to section 234 of title 42 by {k}.", [("transfer", "Transfer", "18", "{s}", None, None, None)]),
    ("Section {s} of title 17, as amended by section 3 of the Act of {k}, is amended in the heading.", [("section_amended_general", "Modify", "17", "{s}", None, None, None)]),
    ("Title 42, United States Code, is hereby amended as {k} says.", [("title_amended", "Modify", "42", None, None, None, None)]),
    ("Title 18, United States Code, is amended by adding a new section {k}.", [("add_new_section", "Add", "18", "{k}", None, None, None)]),
    ("Chapter 12 of title 17, United States Code, is amended by adding at the end the following new section: “{k}. It is.”", [("chapter_amended_add_section", "Add", "17", None, None, None, "{k}. It is.")]),
    ("Title 26, United States Code, is amended— (1) in section {s}(b), by striking \"q{k}\"; and (2) in section 102, by inserting \"r{k}\".", [("title_amended", "Modify", "26", None, None, None, None), ("strike", "Delete", "26", "{s}", "(b)", "q{k}", None), ("insert", "Add", "26", "102", None, None, "r{k}")]),
    ("It is said that {k} was amended, and that sections are repealed.", []),
)


def _value(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_ROWS = ", ".join(f"({i}, {', '.join(map(_value, row))})" for i, (_, rows) in enumerate(INSTRUCTIONS) for row in rows)
_PUT = "replace(replace({}, '{{k}}', CAST(o_orderkey AS VARCHAR)), '{{s}}', CAST(o_custkey % 500 + 1 AS VARCHAR))"


@query(f"""SELECT o_orderkey AS law_id, name AS pattern_name, change AS change_type, CAST(title AS INTEGER) AS title_number, {_PUT.format("section")} AS section_number, path AS subsection_path, {_PUT.format("old")} AS old_text, {_PUT.format("new")} AS new_text
FROM orders JOIN (VALUES {_ROWS}) f(i, name, change, title, section, path, old, new) ON o_orderkey % {len(INSTRUCTIONS)} = i""")
def embedded_edits(spark: SparkSession, d: str) -> DataFrame:
    """Each kind of instruction, with lists, ranges, quotations in quotations and sections that only amended the one that is meant."""
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*(F.lit(x) for x, _ in INSTRUCTIONS)), (k % len(INSTRUCTIONS)).cast("int") + 1)
    text = F.replace(F.replace(form, F.lit("{k}"), k.cast("string")), F.lit("{s}"), (F.col("o_custkey") % 500 + 1).cast("string"))
    out = extract.extract_edits(table(spark, d, "orders").select(k.alias("law_id"), text.alias("text")))
    return out.select("law_id", "pattern_name", "change_type", "title_number", "section_number", "subsection_path", "old_text", "new_text")


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 50 + 1 AS t, o_orderkey % 4 AS v FROM orders)
SELECT k AS o_orderkey, 0 AS position, CAST(CASE WHEN v IN (0, 3) THEN t ELSE 26 END AS INTEGER) AS title_number, CASE v WHEN 2 THEN '7' ELSE CAST(k AS VARCHAR) END AS section_number, CASE v WHEN 0 THEN '(b)(1)' WHEN 1 THEN '(a)(2)(B)' WHEN 3 THEN '(c)(9)' END AS subsection_path FROM o
UNION ALL SELECT k, 1, 26, CAST(k + 1 AS VARCHAR), NULL FROM o WHERE v = 2
UNION ALL SELECT k, 1, 26, '3', NULL FROM o WHERE v = 0""")
def section_references(spark: SparkSession, d: str) -> DataFrame:
    """Sections that prose names, with paths, units, lists and titles."""
    k, t = F.col("o_orderkey"), F.col("o_custkey") % 50 + 1
    text = (
        F.when(k % 4 == 0, said("as in section ", k, "(b)(1) of title ", t, ", and under section 3 of this Act")).when(k % 4 == 1, said("Paragraph (2)(B) of section ", k, "(a) holds."))
        .when(k % 4 == 2, said("See sections 7 and ", k + 1, ".")).otherwise(said("subsection (c)(9) of section ", k, " of title ", t, ", United States Code"))
    )
    rows = spread(table(spark, d, "orders")).select("o_orderkey", F.posexplode(extract.section_references(text, F.lit(26))).alias("position", "r"))
    return rows.select("o_orderkey", "position", "r.title_number", "r.section_number", "r.subsection_path")


# Instructions in XML: parts as laws of several shapes


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS v, p_name AS n, p_type AS t, p_size AS s FROM part)
SELECT k AS law_id, 0 AS seq, 'Modify' AS change_type, 'strike_insert' AS pattern_name, 17 AS title_number, CAST(s AS VARCHAR) AS section_number, '(b)(1)' AS subsection_path, t AS old_text, n AS new_text, 'after' AS qualifier, 'C ' || k AS anchor_text, CAST(NULL AS VARCHAR) AS target_text, CAST(0.98 AS DOUBLE) AS confidence, false AS needs_review FROM p WHERE v = 0
UNION ALL SELECT k, 0, 'Delete', 'strike', 17, CAST(s AS VARCHAR), '(3)(B)', t, NULL, NULL, NULL, NULL, 0.95, false FROM p WHERE v = 1
UNION ALL SELECT k, 1, 'Add', 'add_section', 17, CAST(s AS VARCHAR), '(3)', NULL, '(C) ' || n, 'at_end', NULL, NULL, 0.95, true FROM p WHERE v = 1
UNION ALL SELECT k, 0, 'Delete', 'strike', 17, CAST(s AS VARCHAR), '(c)(2)(A)', NULL, NULL, 'unquoted_target', NULL, 'the period at the end', 0.90, false FROM p WHERE v = 2
UNION ALL SELECT k, 0, 'Add', 'insert_new_text', NULL, CAST(s AS VARCHAR), '(d)', NULL, n, 'before', t, NULL, 0.95, true FROM p WHERE v = 3
UNION ALL SELECT k, 0, 'Repeal', 'repeal', 5, CAST(s AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, 0.90, false FROM p WHERE v = 4
UNION ALL SELECT k, 1, 'Modify', 'substitute', NULL, NULL, NULL, t, n, 'each_place', NULL, NULL, 0.49, true FROM p WHERE v = 4""")
def xml_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Anchors, enclosing places, unquoted targets and quotation marks in amending instructions."""
    k, v, n, t, s = F.col("p_partkey"), F.col("p_partkey") % 5, F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")
    act = lambda kind, word: f'<amendingAction type="{kind}">{word}</amendingAction>'
    q = lambda x: F.concat(F.lit("<quotedText>“"), x, F.lit("”</quotedText>"))
    strike, insert, amend = act("delete", "striking"), act("insert", "inserting"), act("amend", "amended")
    ref = F.concat(F.lit('<ref href="/us/usc/t17/s'), s, F.lit('">section '), s, F.lit("</ref>"))
    body = (
        F.when(v == 0, said("In ", ref, f"(b)(1), by {strike} ", q(t), f" and {insert} ", q(n), " after ", q(said("C ", k)), "."))
        .when(v == 1, said("<chapeau>", ref, f" is {amend}—</chapeau><paragraph><num>(1)</num> in paragraph (3)—<subparagraph>in subparagraph (B), by {strike} ", q(t), f"; and</subparagraph><subparagraph>by {act('add', 'adding')} at the end <quotedContent>“<p>“(C) ", n, "</p>”</quotedContent>.</subparagraph></paragraph>"))
        .when(v == 2, said('Section <ref href="/us/usc/t17/s', s, f'/c"/> is {amend} in paragraph (2)(A), by {strike} the period at the end.'))
        .when(v == 3, said("Section ", s, f"(d) is {amend} by {insert} ", q(n), " before ", q(t), "."))
        .otherwise(said('<ref href="/us/usc/t5/s', s, f'"/> is {act("repeal", "repealed")}.</section><section role="instruction">The Act is {amend} each place by {act("substitute", "substituting")} ', q(t), ", ", q(n), "."))
    )
    xml = said('<law xmlns="http://schemas.gpo.gov/xml/uslm"><section role="instruction">', body, "</section></law>")
    out = xml_edits.extract_xml_edits(table(spark, d, "part").select(k.alias("law_id"), xml.alias("xml")))
    return out.select("law_id", "seq", "change_type", "pattern_name", "title_number", "section_number", "subsection_path", "old_text", "new_text", "qualifier", "anchor_text", "target_text", F.round("confidence", 6).alias("confidence"), "needs_review")


# Differences of lines, and what lines go back to


@query("""SELECT o_custkey, count(*) FILTER (o_orderkey % 4 <> 1 AND o_orderkey % 3 = 0) AS added, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 4 = 1) AS removed FROM orders
WHERE (o_orderkey % 3 <> 0) <> (o_orderkey % 4 <> 1) GROUP BY 1""")
def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines added and removed between two texts of each customer's orders."""
    k = F.col("o_orderkey")
    text = lambda keep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, k))), lambda x: F.concat(F.lit("order "), x.cast("string"))), "\n")
    pairs = table(spark, d, "orders").groupBy("o_custkey").agg(text(k % 3 != 0).alias("old"), text(k % 4 != 1).alias("new"))
    return apply.line_counts(apply.line_hunks(pairs, ["o_custkey"], "old", "new"), ["o_custkey"])


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS v FROM part),
l AS (
  SELECT k, 1 AS pos, 'c ' || k AS content, 1 AS made, 1 AS changed, 3 AS moved FROM p WHERE v = 0 UNION ALL SELECT k, 2, 'a ' || k, 1, 1, NULL FROM p WHERE v = 0
  UNION ALL SELECT k, 3, 'b of new words ' || k, 1, 2, NULL FROM p WHERE v = 0 UNION ALL SELECT k, 4, 'd ' || k, 3, 3, NULL FROM p WHERE v = 0
  UNION ALL SELECT k, 1, 'a ' || k, 1, 1, NULL FROM p WHERE v = 1 UNION ALL SELECT k, 2, 'b ' || k, 1, 1, NULL FROM p WHERE v = 1 UNION ALL SELECT k, 3, 'c ' || k, 1, 1, NULL FROM p WHERE v = 1
  UNION ALL SELECT k, 1, 'all is new ' || k, 3, 3, NULL FROM p WHERE v = 2
  UNION ALL SELECT k, 1, 'first ' || k, 2, 2, NULL FROM p WHERE v = 3 UNION ALL SELECT k, 2, 'a ' || k, 1, 1, NULL FROM p WHERE v = 3 UNION ALL SELECT k, 3, 'b ' || k || ' again', 1, 3, NULL FROM p WHERE v = 3
)
SELECT k AS p_partkey, CAST(pos AS INTEGER) AS line_number, content, CAST(made AS BIGINT) AS created_in, CASE WHEN made > 1 THEN 'Pub. L. 115–' || made END AS created_law, CAST(changed AS BIGINT) AS changed_in, CASE WHEN changed > 1 THEN 'Pub. L. 115–' || changed END AS changed_law, CAST(moved AS BIGINT) AS moved_in FROM l""")
def line_blame(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stay, are edited, move, go and come in three revisions, with the laws behind them; the first revision is no law's."""
    k, v = F.col("p_partkey"), F.col("p_partkey") % 4
    text = lambda *lines: said(*(x for i, line in enumerate(lines) for x in (("\n",) if i else ()) + (line, " ", k)))
    first = text("a", "b", "c")
    second = F.when(v == 0, text("a", "b of new words", "c")).when(v == 3, text("first", "a", "b"))
    third = F.when(v == 0, text("c", "a", "b of new words", "d")).when(v == 1, first).when(v == 2, text("all is new")).otherwise(said(text("first", "a", "b"), " again"))
    rows = F.array(*(F.struct(F.lit(n).cast("long").alias("revision_id"), F.lit(n).alias("sequence_number"), t.alias("text_content")) for n, t in ((1, first), (2, second), (3, third))))
    states = table(spark, d, "part").select("p_partkey", v.alias("v"), F.explode(rows).alias("r")).select("p_partkey", "v", "r.*")
    # A section has a row only where it changed; the third kind is deleted in between.
    states = states.where("text_content IS NOT NULL OR v = 2").drop("v")
    revisions = spark.range(1, 4).select(F.col("id").alias("revision_id"), F.when(F.col("id") > 1, F.col("id")).alias("law_id"), F.lit("2020-01-01").cast("date").alias("effective_date"))
    laws = spark.range(2, 4).select(F.col("id").alias("law_id"), said("Pub. L. 115–", F.col("id")).alias("label"))
    lines = blame.with_laws(blame.blame(states, ["p_partkey"]), revisions, laws, ["p_partkey"])
    return lines.select("p_partkey", "line_number", "content", "created_in", "created_law", "changed_in", "changed_law", "moved_in")


# Title files: nations as titles, their suppliers as sections


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name AS name, s_nationkey % 3 AS v FROM supplier)
SELECT n + 1 AS title_number, CAST(k AS VARCHAR) AS section_number, 'Head of ' || name AS heading, 'Text' || CASE WHEN v = 0 THEN '[1]' ELSE '' END || ' of ' || k || ':' || chr(10) || '(a) First, ' || k || '.' || chr(10) || chr(9) || '(1) Deep.' AS text_content,
  CASE WHEN v = 2 THEN 'title:' || (n + 1) ELSE 'title:' || (n + 1) || '/chapter:' || (n + 1) || 'A' END AS group_key FROM s""")
def title_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections out of title files of three forms, footnotes taken out of them."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    foot = '<ref class="footnoteRef">1</ref><note type="footnote"><num>1</num> So in original.</note>'
    section = said(
        '<section><num value="', k, '">§ ', k, ".</num><heading>Head of ", F.col("s_name"), F.when(n % 3 == 0, foot).otherwise(""), "</heading><chapeau>Text", F.when(n % 3 == 0, foot).otherwise(""), " of ", k,
        ' :</chapeau><subsection><num value="a">(a)</num><content>First , ', k, '.</content><paragraph><num value="1">(1)</num><content>Deep.</content></paragraph></subsection></section>',
    )
    # A nation's suppliers make up one file, as a title's sections do.
    files = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(section), "").alias("body"))
    number, body = n + 1, F.col("body")
    chapter = said('<chapter><num value="', number, 'A"/><heading>C</heading>', body, "</chapter>")
    text = (
        F.when(n % 3 == 0, said('<uslm xmlns="http://schemas.gpo.gov/xml/uslm"><main><title><num value="', number, '"/><heading>T</heading>', chapter, "</title></main></uslm>"))
        .when(n % 3 == 1, said("<uscDoc><meta><docNumber>", number, '</docNumber></meta><body><level role="chapter"><num value="', number, 'A"/>', body, "</level></body></uscDoc>"))
        .otherwise(said('<x identifier="/us/usc/t', number, '"><wrap>', body, "</wrap></x>"))
    )
    out = uslm.parse_sections(files.select(n.cast("string").alias("path"), text.alias("text")))
    return out.select("title_number", "section_number", "heading", "text_content", "group_key")


# Where words stand, forms of rows, and edits parsed when asked for


@query("""WITH w AS (SELECT doc_id, text, substr(text, 21, 60) AS said FROM documents WHERE length(text) >= 200),
q AS (SELECT *, regexp_escape(substr(said, 1, 30)) || '(?s:.)' || regexp_escape(substr(said, 32)) AS pattern FROM w WHERE regexp_matches(substr(said, 1, 1), '[^ \\t\\n\\r]') AND regexp_matches(substr(said, 60, 1), '[^ \\t\\n\\r]')),
f AS (SELECT doc_id, text, strpos(text, regexp_extract(text, pattern)) - 1 AS p FROM q)
SELECT doc_id, CAST(p AS INTEGER) AS start_pos, CAST(p + 60 AS INTEGER) AS end_pos, 1 AS distance FROM f""")
def approximate_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of documents found again by sixty characters, one of them changed."""
    docs = table(spark, d, "documents").where("length(text) >= 200")
    words = F.substring("text", 21, 60)
    docs = docs.where(F.substring(words, 1, 1).rlike(r"[^ \t\n\r]") & F.substring(words, 60, 1).rlike(r"[^ \t\n\r]"))
    changed = F.concat(F.substring(words, 1, 30), F.lit("☃"), F.substring(words, 32, 29))
    return spread(docs).select("doc_id", spans.spans_of(F.col("text"), changed).alias("s")).select("doc_id", "s.*")


@query("""SELECT p_partkey AS law_id, CASE WHEN p_partkey % 3 = 0 THEN 'xml' ELSE 'text' END AS source, 'Modify' AS change_type, 17 AS title_number, CAST(p_size AS VARCHAR) AS section_number, 'old ' || p_partkey % 4 AS old_text, 'new ' || p_partkey AS new_text, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_partkey % 4 + 1 AS INTEGER) END AS start_line FROM part
UNION ALL SELECT p_partkey, 'xml', 'Modify', 17, CAST(p_size AS VARCHAR), 'x', 'y', NULL FROM part WHERE p_partkey % 3 = 0""")
def edits_when_asked(spark: SparkSession, d: str) -> DataFrame:
    """Edits of laws by their XML, by their text where XML is missing, broken or says nothing, and the lines where they begin."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    part = table(spark, d, "part")
    quoted = lambda x: F.concat(F.lit("<quotedText>"), x, F.lit("</quotedText>"))
    edit = lambda old, new: said('<amendingAction type="delete">striking</amendingAction> ', quoted(old), ' and <amendingAction type="insert">inserting</amendingAction> ', quoted(new))
    old, new = said("old ", k % 4), said("new ", k)
    head = said('<section role="instruction"><chapeau>Section <ref href="/us/usc/t17/s', size, '"/> is <amendingAction type="amend">amended</amendingAction></chapeau>')
    xml = F.when(k % 3 == 0, said("<law>", head, "<paragraph>by ", edit(old, new), "</paragraph><paragraph>by ", edit(F.lit("x"), F.lit("y")), "</paragraph></section></law>")).when(k % 3 == 1, F.when(k % 2 == 0, "<broken").otherwise("<law><section>No instruction.</section></law>"))
    laws = part.select(k.alias("law_id"), xml.alias("xml"), said("Section ", size, ' of title 17 is amended by striking "', old, '" and inserting "', new, '".').alias("text"))
    lines = part.select(F.lit(17).alias("title_number"), size.alias("section_number")).distinct()
    lines = lines.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("line_number")).withColumn("content", said("line with old ", F.col("line_number") - 1, " in it"))
    return records.parsed_when_asked(laws, lines).select("law_id", "source", "change_type", "title_number", "section_number", "old_text", "new_text", "start_line")


@query("""SELECT l.o_custkey % 20 + 95 AS congress, l.o_orderkey AS law_number, CASE WHEN l.o_orderkey % 3 > 0 THEN 'htm ' || l.o_orderkey END AS htm_content, CASE WHEN l.o_orderkey % 3 <> 1 THEN 'xml ' || l.o_orderkey END AS xml_content,
  CASE WHEN l.o_orderkey % 5 > 0 THEN CASE WHEN l.o_orderkey % 2 = 0 THEN 'Popular ' || l.o_orderkey ELSE 'Official ' || l.o_orderkey END END AS title FROM orders l""")
def law_texts(spark: SparkSession, d: str) -> DataFrame:
    """Laws' texts in two formats, with titles where the law is known."""
    k, congress = F.col("o_orderkey"), (F.col("o_custkey") % 20 + 95).alias("congress")
    orders = table(spark, d, "orders")
    laws = orders.where(k % 5 > 0).select(congress, k.alias("law_number"), F.when(k % 2 == 0, said("Popular ", k)).alias("popular_name"), F.lit(None).cast("string").alias("short_title"), said("Official ", k).alias("official_title"), F.lit("2020-01-01").cast("date").alias("enacted_date"))
    formats = F.array_compact(F.array(F.when(k % 3 > 0, F.lit("htm")), F.when(k % 3 != 1, F.lit("xml"))))
    texts = orders.select(congress, k.alias("law_number"), F.explode(formats).alias("format")).withColumn("content", said(F.col("format"), " ", F.col("law_number")))
    return records.law_texts(laws, texts).select("congress", "law_number", "htm_content", "xml_content", "title")


@query("""WITH s AS (SELECT CAST(l_suppkey % 50 + 1 AS INTEGER) AS t, CAST(l_partkey AS VARCHAR) AS s, l_orderkey AS n, max(struct_pack(h := sha256(l_returnflag), d := l_linestatus = 'F' AND l_returnflag = 'R')) AS x FROM lineitem GROUP BY ALL),
c AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL OR lag(x) OVER w <> x THEN n END AS changed FROM s WINDOW w AS (PARTITION BY t, s ORDER BY n)),
g AS (SELECT t, s, count(*) AS versions, NOT arg_max(x.d, n) AS live, max(changed) AS last_changed FROM c GROUP BY t, s)
SELECT t AS title_number, count(*) FILTER (live) AS live_sections, CAST(sum(versions) AS BIGINT) AS versions, max(last_changed) AS last_changed FROM g GROUP BY t""")
def live_section_counts(spark: SparkSession, d: str) -> DataFrame:
    """Live sections, versions and last changes of titles; line items are revisions of their parts."""
    items = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50 + 1).cast("int").alias("title_number"), F.col("l_partkey").cast("string").alias("section_number"), F.col("l_orderkey").alias("sequence_number"), F.sha2("l_returnflag", 256).alias("text_hash"), ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("is_deleted"))
    return live.title_counts(live.live_sections_of(items))


@query("""SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN 'hr' WHEN 1 THEN 's' WHEN 2 THEN 'hjres' WHEN 3 THEN 'sconres' END AS bill_type, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_custkey AS INTEGER) END AS bill_number FROM orders""")
def bills_of_laws(spark: SparkSession, d: str) -> DataFrame:
    """Bills of laws, by their own columns or read out of where they come from."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 5 == 0, F.when(k % 2 == 0, "H.R."))
    origin = F.when(k % 5 == 0, said("H.R. ", n)).when(k % 5 == 1, said("s", n)).when(k % 5 == 2, said("H. J. Res. ", n)).when(k % 5 == 3, said("S.Con.Res.", n)).otherwise(said("Public ", n, "x"))
    bill = records.bill_of(kind, F.when(kind.isNotNull(), n), origin)
    return table(spark, d, "orders").select("o_orderkey", bill["bill_type"].alias("bill_type"), bill["bill_number"].alias("bill_number"))


@query("SELECT CAST(p_size AS VARCHAR) AS number, CAST(row_number() OVER (ORDER BY CAST(p_size AS VARCHAR)) AS INTEGER) AS place FROM (SELECT DISTINCT p_size FROM part)")
def titles_in_text_order(spark: SparkSession, d: str) -> DataFrame:
    """Titles in the order of their numbers as text."""
    groups = table(spark, d, "part").select(F.col("p_size").cast("string").alias("number"), F.lit("title").alias("group_type")).distinct()
    return records.placed_titles(groups).select("number", "place")
