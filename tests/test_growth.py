"""Results and bounds that only larger tables show."""

import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.functions import citations, text
from palimpsest.operators import anchored, apply, batches, extract, metrics, xml_edits


def test_laws_are_cited_with_all_their_digits(spark):
    said = F.lit("see Pub. L. 115-10000, Public Law 115-10001 and Pub. L. 1151-7; Public Law 115-10000")
    assert spark.range(1).select(text.public_laws(said)).first()[0] == ["115-10000", "115-10001", "1151-7"]


def test_texts_are_collapsed_once_for_their_difference(spark):
    """Each text is collapsed once, not once for each step of the search."""
    pairs = [("a  b", "a b"), ("", "x"), ("abc", "abd"), ("é" * 50 + "x" + "y" * 30, "é" * 50 + "z" + "y" * 30), ("q" * 64 + "1", "q" * 64 + "2"), ("1rest", "2rest"), (None, "x")]
    df = spark.createDataFrame(pairs, "old string, new string").select(citations.described_difference(F.col("old"), F.col("new")).alias("d"))
    around = lambda a: "'..." + a + "...'"
    assert [r["d"] for r in df.collect()] == [
        None, "Length differs: DB=0, RP=1 (delta=1)", f"First diff at char 2: DB={around('abc')} vs RP={around('abd')}",
        f"First diff at char 50: DB={around('é' * 20 + 'x' + 'y' * 19)} vs RP={around('é' * 20 + 'z' + 'y' * 19)}",
        f"First diff at char 64: DB={around('q' * 20 + '1')} vs RP={around('q' * 20 + '2')}", f"First diff at char 0: DB={around('1rest')} vs RP={around('2rest')}", None,
    ]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2
    spans = spark.createDataFrame([("Sections 9 through 11",), ("sections 3 through 1",), ("sections 4, 5a, and 6",), ("none",), (None,)], "t string")
    assert [r[0] for r in spans.select(citations.section_list(F.col("t"))).collect()] == [["9", "10", "11"], [], ["4", "5a", "6"], [], None]


def test_pairs_are_counted_in_parts_that_grow_in_number(spark, monkeypatch):
    rows = spark.createDataFrame([(g, m) for g in range(40) for m in (1, 2, 2 + g % 3, None)] + [(None, 1), (None, 2)], "g long, m long")
    want = {(1, 2): 40, (1, 3): 13, (1, 4): 13, (2, 3): 13, (2, 4): 13}
    monkeypatch.setattr(metrics, "EACH", 20)
    got = metrics.shared_pairs(rows, "g", "m")
    assert {(r["a"], r["b"]): r["shared"] for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == 9


def test_sections_are_dealt_to_parts_by_their_changes(spark, monkeypatch):
    monkeypatch.setattr(anchored, "EACH", 100)
    lines = spark.range(90).selectExpr("id AS k", "1 AS line_number", "'(a)' AS marker", "concat('(a) text ', id) AS content", "0 AS indent_level")
    null, none = "CAST(NULL AS STRING)", "CAST(NULL AS ARRAY<STRING>)"
    changes = spark.range(80).selectExpr("id AS k", "1L AS change_id", "'Add' AS change_type", f"{null} AS old_text", "'(b) new' AS new_text", f"{null} AS position", f"{null} AS anchor", f"{none} AS old_markers", f"{none} AS new_markers", f"{null} AS instruction")
    after, done = anchored.apply_anchored(anchored.keyed(lines, ["k"]), changes, ["k"])
    assert done.count() == 80 and done.rdd.getNumPartitions() == 8
    assert after.count() == 170 and after.where("content = '(b) new'").count() == 80 and after.where("line_number = 1 AND content = concat('(a) text ', k)").count() == 90


def test_workers_hold_a_slice_of_a_batch(spark):
    table = pa.table({"t": ["x" * 1000] * 5000 + ["y" * 3_000_000, "z"]}).to_batches()[0]
    parts = list(batches.slices(table))
    assert max(p.nbytes for p in parts if p.num_rows > 1) <= batches.SLICE and pa.Table.from_batches(parts).to_pydict() == table.to_pydict()
    df = spark.createDataFrame([(1, "ab"), (None, None), (3, "")], "k long, t string")
    got = batches.flat_mapped(df, lambda k, t: [(k, c, None) for c in t or "-"] * 2, "k long, c string, n int")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", None), (1, "b", None), (None, "-", None), (3, "-", None)] * 2, key=str)


def test_texts_do_not_reach_workers_as_whole_batches(spark):
    """The named steps take Arrow batches, of which they read a slice at a time, and no frames."""
    texts = spark.createDataFrame([(1, "a\nb", "a\nc")], "k long, old string, new string")
    for df in (apply.line_hunks(texts, ["k"], "old", "new"), extract.extract_edits(texts, "k", "old"), xml_edits.extract_xml_edits(texts, "k", "old")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan
