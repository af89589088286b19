"""Forms of rows, look-ups, spans and states that streams keep, on small tables."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import catalog, chrono, committees, extract, maintenance, notes, process, records, snapshots, spans, viewer
from palimpsest.streaming import incremental, live


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], min(before + (c != d), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_spans_are_as_near_as_any():
    rng = random.Random(1)
    for _ in range(600):
        text, said = ("".join(rng.choice("abc ") for _ in range(rng.randrange(n))) for n in (14, 7))
        said = said.strip()
        best = [min(edit_distance(text[i:e], said) for i in range(e + 1)) for e in range(len(text) + 1)]
        assert spans.distances(text, said) == best
        assert spans.distances(text, said, False) == [edit_distance(text[:e], said) for e in range(len(text) + 1)]
        start, end, distance = spans.approximate_span(text, said)
        assert distance == min(best) == edit_distance(text[start:end], said)


def test_spans_of_nulls_and_long_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    rows = [(1, "it says this here", "said thus"), (2, None, "x"), (3, "x", None), (4, "", "ab"), (5, "ab", ""), (6, long, long[5000:5500].replace("a", "☃", 5))]
    got = {r["k"]: r["s"] and tuple(r["s"]) for r in spark.createDataFrame(rows, "k int, t string, w string").select("k", spans.spans_of(F.col("t"), F.col("w")).alias("s")).collect()}
    assert got == {1: (3, 12, 3), 2: None, 3: None, 4: (0, 0, 2), 5: (0, 0, 0), 6: (5000, 5500, 5)}


def test_spans_as_json(spark):
    d = spark.createDataFrame([(1, 5, 9, "claimed", "strike", "abcd"), (1, 0, 3, "flagged", None, "xyz")], "law_id int, start_pos int, end_pos int, kind string, pattern_name string, text string")
    assert spans.spans_json(d, ["law_id"]).first()["json"] == '{"spans":2,"length":7,"items":[{"start_pos":0,"end_pos":3,"kind":"flagged","text":"xyz"},{"start_pos":5,"end_pos":9,"kind":"claimed","pattern_name":"strike","text":"abcd"}]}'
    assert "text" not in spans.spans_json(d, ["law_id"], with_text=False).first()["json"]


# Forms of rows


def test_states_roots_orders_and_counts(spark):
    d = spark.createDataFrame([(5, "10", "x", None), (5, "2", "y", True), (1, "3", "z", False)], "title_number int, section_number string, text_content string, is_deleted boolean")
    states = records.as_states(d)
    assert states.columns == records.STATE and [(r["title_number"], r["section_number"], r["is_deleted"], r["heading"]) for r in records.ordered(states).collect()] == [(1, "3", False, None), (5, "10", False, None), (5, "2", True, None)]
    groups = spark.createDataFrame([("2", "title"), ("10", "title"), ("1", "title"), ("1", "chapter")], "number string, group_type string")
    assert [(r["number"], r["place"]) for r in records.placed_titles(groups).orderBy("place").collect()] == [("1", 1), ("10", 2), ("2", 3)]
    root = records.root_revision(spark.createDataFrame([(7, "113-21", date(2013, 7, 18))], "release_point_id long, identifier string, publication_date date")).first()
    assert (root["sequence_number"], root["parent_revision_id"], root["is_ground_truth"], root["status"], root["effective_date"]) == (0, None, True, "Ingesting", date(2013, 7, 18))
    laws = spark.createDataFrame([(1,), (2,), (2,), (None,)], "law_id int")
    assert {r["law_id"]: r["existing"] for r in records.existing(spark.createDataFrame([(1,), (1,), (3,)], "law_id int"), laws, ["law_id"]).collect()} == {1: 2, 2: 0, None: 0}
    chapters = spark.createDataFrame([(531,), (9,)], "chapter int")
    assert {tuple(r) for r in records.act_titles(chapters, spark.createDataFrame([(531, "Social Security Act")], "chapter int, title string")).collect()} == {(531, "Social Security Act"), (9, None)}


def test_bills(spark):
    rows = [("H.R.", 5, "x"), (None, None, "H. Con. Res. 12"), ("zz", 5, "S 3"), ("S.", None, ""), (None, 4, None)]
    got = spark.createDataFrame(rows, "t string, n int, o string").select(records.bill_of(F.col("t"), F.col("n"), F.col("o")).alias("b")).collect()
    assert [r["b"] and tuple(r["b"]) for r in got] == [("hr", 5), ("hconres", 12), ("s", 3), None, None]


# Look-ups


def test_look_ups(spark):
    laws = spark.createDataFrame([(115, "97"), (115, "98"), (114, "97")], "congress int, law_number string")
    assert [tuple(r) for r in catalog.law_by_number(laws, 115, "97").collect()] == [(115, "97")] and catalog.law_by_number(laws, 115, "x").count() == 0
    points = spark.createDataFrame([(113, "113-30", date(2013, 9, 1)), (113, "113-21", date(2013, 7, 1)), (114, "114-1", None)], "congress int, identifier string, publication_date date")
    assert [r["identifier"] for r in catalog.release_points_of(points, 113).collect()] == ["113-21", "113-30"]
    sections = spark.createDataFrame([(17, "1", "h", 3, False, "long")], "title_number int, section_number string, heading string, sort_order int, is_repealed boolean, text string")
    assert catalog.structure_scan(sections).columns == ["title_number", "section_number", "heading", "sort_order", "is_repealed"]
    found = spark.createDataFrame([(1, "a" * 60 + "b", date(2020, 1, 1)), (2, "x" + "a" * 55, date(2020, 1, 2)), (3, "other", date(2020, 1, 3))], "discovery_id int, text string, created_at date")
    assert [r["discovery_id"] for r in catalog.similar_discoveries(found, "a" * 70, 5).collect()] == [2, 1]
    known = spark.createDataFrame([("p", "Add", 0.9), ("q", "Add", 0.5), ("r", "Repeal", 0.9)], "name string, change_type string, confidence double")
    assert {r["name"] for r in catalog.patterns(known, "Add").collect()} == {"p", "q"} and {r["name"] for r in catalog.patterns(known, least=0.9).collect()} == {"p", "r"}


def test_owners_and_jurisdictions(spark):
    mappings = spark.createDataFrame([("hsag00", 7), ("zz", 9)], "committee_code string, title_number int")
    ok, rejected = committees.resolved_owners(mappings, spark.createDataFrame([("hsag00", 1)], "committee_code string, committee_id int"))
    assert [(r["committee_id"], r["title_number"]) for r in ok.collect()] == [(1, 7)] and [r["committee_code"] for r in rejected.collect()] == ["zz"]
    known = spark.createDataFrame([(118, "hsag00", "old"), (118, "hsbu00", "kept")], "congress int, committee_code string, jurisdiction_text string")
    found = spark.createDataFrame([(118, "hsag00", "new", "X(a)"), (118, None, "lost", "X(b)")], "congress int, committee_code string, jurisdiction_text string, rule_citation string")
    rows, unknown = committees.upsert_jurisdictions(known, found)
    assert {(r["committee_code"], r["jurisdiction_text"], r["rule_citation"]) for r in rows.collect()} == {("hsag00", "new", "X(a)"), ("hsbu00", "kept", None)} and [r["jurisdiction_text"] for r in unknown.collect()] == ["lost"]


def test_backfills_and_titles(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "b", "b"), (3, None, None)], "k int, source string, v string")
    assert maintenance.backfilled(d, ["k"], "v", F.col("source")).first()["changed"] == 1
    assert [tuple(r) for r in maintenance.backfilled(d, ["k"], "v", F.col("source"), dry_run=False).collect()] == [(1, "a", "a")]
    texts = spark.createDataFrame([(1, "x"), (1, None), (2, None)], "title_number int, text_content string")
    assert {tuple(r) for r in maintenance.with_text(texts).collect()} == {(1, 1), (2, 0)}
    names = spark.createDataFrame([(["A"], "s", "o"), ([], "s", "o"), (None, None, "o")], "a array<string>, s string, o string")
    assert [r[0] for r in names.select(process.display_title(F.col("a"), F.col("s"), F.col("o"))).collect()] == ["A", "s", "o"]
    report = spark.createDataFrame([(80.0, 0, 10, 0), (90.0, 3, 10, 0), (90.0, 2, 10, 6), (90.0, 2, 10, 5), (90.0, 0, 0, 0)], "coverage double, needs_review int, edits int, flagged int")
    assert [r["escalate"] for r in extract.escalated(report).collect()] == [True, True, True, False, False]


def test_summaries_and_roles(spark):
    states = spark.createDataFrame([(17, "1", "g", "Head", 2, "1990—Pub. L. 101–5 struck out it."), (17, "2", "g", "Head", 3, None)], "title_number int, section_number string, group_id string, heading string, sort_order int, notes string")
    assert [(r["section_number"], r["last_amendment_year"], r["last_amendment_law"]) for r in viewer.section_summary(states).orderBy("sort_order").collect()] == [("1", 1990, "PL 101-5"), ("2", None, None)]
    doc = notes.notes_document(spark.createDataFrame([(1, "(Pub. L. 94–553, § 1; Pub. L. 100–1, title I.)")], "k int, raw_notes string"), ["k"])
    assert [(r["position"], r["congress"], r["role"]) for r in notes.reference_roles(doc, ["k"]).orderBy("position").collect()] == [(0, 94, "Enactment"), (1, 100, "Amendment")]


def test_played_revisions_and_their_report(spark):
    states = spark.createDataFrame([(1, "1", "old text"), (1, "2", "stays")], "title_number int, section_number string, text_content string")
    laws = spark.createDataFrame([(9, 115, "1", date(2018, 1, 1))], "law_id long, congress int, law_number string, enacted_date date")
    changes = spark.createDataFrame([(1, 9, 1, "1", "Modify", "old", "new"), (2, 9, 1, "2", "Modify", "nowhere", "x")], "change_id long, law_id long, title_number int, section_number string, change_type string, old_text string, new_text string")
    got = chrono.played_states(states, changes, laws, 8, 7).collect()
    assert [(r["section_number"], r["text_content"], r["revision_id"], r["parent_revision_id"]) for r in got] == [("1", "new text", 8, 7)]
    outcomes = spark.createDataFrame([("L1", "applied", 2), ("L2", "deferred", 0)], "identifier string, outcome string, changes long")
    same = spark.createDataFrame([(1, "1", "a", "n", False)], "title_number int, section_number string, text_hash string, notes_hash string, is_deleted boolean")
    from palimpsest.operators.compare import checkpoint

    report = chrono.advance_report(outcomes, checkpoint(same, same, snapshots.KEY)).collect()
    assert len(report) == 1 and (report[0]["laws_applied"], report[0]["laws_deferred"], report[0]["laws_failed"], report[0]["changes"]) == (1, 1, 0, 2)


# Streams


@pytest.mark.parametrize("seed", [1, 2])
def test_live_sections_of_late_revisions(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(t, str(s), n, rng.choice("ab"), rng.random() < 0.2) for t in (1, 2) for s in range(4) for n in rng.sample(range(12), rng.randrange(1, 9))]
    rows += rows[:3]
    rng.shuffle(rows)
    kinds = "title_number int, section_number string, sequence_number long, text_hash string, is_deleted boolean"
    want = {(r["title_number"], r["section_number"]): tuple(r)[2:] for r in live.live_sections_of(spark.createDataFrame(rows, kinds)).collect()}
    for (t, s), got in want.items():
        own = {}
        for a, b, n, h, x in rows:
            if (a, b) == (t, s):
                own[n] = max(own.get(n, ("", False)), (h, x))
        order = sorted(own)
        changed = [n for i, n in enumerate(order) if not i or own[n] != own[order[i - 1]]]
        assert got == (len(order), not own[order[-1]][1], changed[-1])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        target = incremental.NewestRows(spark, str(tmp_path / "t"), ["title_number", "section_number"])
        for part in (rows[::2], rows[1::2]):  # the second half comes after the query has stopped and starts again
            spark.createDataFrame(part, kinds).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
            stream = incremental.files(spark, str(tmp_path / "in"), spark.createDataFrame([], kinds).schema, most_files=1)
            live.keep(stream, target, str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["title_number"], r["section_number"]): (r["versions"], r["live"], r["last_changed"]) for r in target.read().collect()}
    assert got == want
    counts = {r["title_number"]: tuple(r)[1:] for r in live.title_counts(target.read()).collect()}
    assert counts == {t: (sum(x[1] for k, x in want.items() if k[0] == t), sum(x[0] for k, x in want.items() if k[0] == t), max(x[2] for k, x in want.items() if k[0] == t)) for t in (1, 2)}
