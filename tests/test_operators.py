import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dates, text
from palimpsest.operators import apply, compare, extract, intervals, relations, snapshots

SNAP = "snapshot_id long, revision_id long, title_number int, section_number string, text_hash string, is_deleted boolean"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def chain_of(spark, links, head):
    return snapshots.revision_chain(spark.createDataFrame(links, "revision_id long, parent_revision_id long"), head)


def test_chain_walks_parents_and_stops_at_gaps_and_loops(spark):
    assert rows(chain_of(spark, [(1, None), (2, 1), (3, 2), (9, 1)], 3)) == [(1, 2), (2, 1), (3, 0)]
    assert rows(chain_of(spark, [(2, 7), (3, 2)], 3)) == [(2, 1), (3, 0)]
    assert rows(chain_of(spark, [(1, 1)], 1)) == [(1, 0)]
    assert rows(chain_of(spark, [], 1)) == []


def test_chain_by_doubling_equals_the_walk(spark, monkeypatch):
    links = [(k, k - 1 if k > 1 else None) for k in range(1, 23)]
    walked = rows(chain_of(spark, links, 21))
    monkeypatch.setattr(snapshots, "MOST_WALKED", 3)
    assert rows(chain_of(spark, links, 21)) == walked


def test_states_take_the_newest_on_the_chain_then_drop_tombstones(spark):
    s = spark.createDataFrame([(1, 1, 17, "a", "x", False), (2, 2, 17, "a", "y", False), (3, 3, 17, "a", None, True), (4, 1, 17, "b", "z", False), (5, 9, 17, "b", "off", False), (7, 2, 17, "c", "q", False), (6, 2, 17, "c", "p", False)], SNAP)
    chain = chain_of(spark, [(1, None), (2, 1), (3, 2), (9, 1)], 3)
    assert rows(snapshots.states_at(s, chain).select("section_number", "text_hash")) == [("b", "z"), ("c", "p")]
    chain = chain_of(spark, [(1, None), (2, 1), (3, 2)], 2)
    assert rows(snapshots.states_at(s, chain).select("section_number", "text_hash")) == [("a", "y"), ("b", "z"), ("c", "p")]
    assert rows(snapshots.duplicate_keys(s)) == [(2, 17, "c", 2)]


def test_real_changes_count_missing_hashes(spark):
    s = spark.createDataFrame([(1, 1, 17, "a", "x", False), (2, 2, 17, "a", "x", False), (3, 3, 17, "a", None, False), (4, 4, 17, "a", "x", False)], SNAP)
    chain = chain_of(spark, [(1, None), (2, 1), (3, 2), (4, 3)], 4)
    assert rows(snapshots.real_changes(s, chain).select("snapshot_id")) == [(1,), (3,), (4,)]
    assert rows(snapshots.last_changed(s, chain).select("revision_id")) == [(4,)]


def test_blame_finds_since_when_a_line_has_stayed(spark):
    s = spark.createDataFrame([(1, 1, 1, "a", "one\ntwo"), (2, 2, 1, "a", "one\nthree"), (3, 3, 1, "a", "one\ntwo")], "snapshot_id long, revision_id long, title_number int, section_number string, text_content string")
    chain = chain_of(spark, [(1, None), (2, 1), (3, 2)], 3)
    assert rows(snapshots.blame(s, chain).select("line", "since_revision")) == [("one", 1), ("two", 3)]


def test_diff_and_checkpoint(spark):
    kind = "k int, text_hash string, notes_hash string, is_deleted boolean"
    a = spark.createDataFrame([(1, "x", None, False), (2, "x", "n", False), (3, "x", None, False), (5, None, None, False)], kind)
    b = spark.createDataFrame([(1, "x", None, False), (2, "y", "n", False), (4, "z", "m", False), (5, None, "q", True)], kind)
    assert rows(compare.diff_states(a, b, ["k"])) == [(1, "unchanged", False, False), (2, "modified", True, False), (3, "deleted", True, False), (4, "added", True, True), (5, "modified", False, True)]
    assert rows(compare.checkpoint(a, b, ["k"])) == [(1, "match"), (2, "text_mismatch"), (3, "only_derived"), (4, "only_truth"), (5, "deleted_mismatch")]
    assert compare.checkpoint_summary(compare.checkpoint(a, a, ["k"])).first()["is_clean"]
    empty = a.where("false")
    assert tuple(compare.precision_recall(empty, empty, ["k"]).first()) == (0, 0, 0, 0.0, 0.0)


def test_as_of_join_takes_the_newest_value_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "b"), (1, 5, "c"), (1, 6, "d")], "k int, u int, v string")
    assert rows(relations.as_of_join(left, right, ["k"], "t", "u", ["v"])) == [(1, 1, None), (1, 5, "c"), (2, 9, None)]


def test_closure_and_upsert(spark):
    n = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")
    assert rows(relations.closure(n).where("depth > 0")) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    t, s = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n"), (3, "n")], "k int, v string")
    assert rows(relations.upsert(t, s, ["k"])) == [(1, "x"), (2, "n"), (3, "n")]
    assert rows(relations.upsert(t, s, ["k"], update=False)) == [(1, "x"), (2, "y"), (3, "n")]
    known, unknown = relations.split_known(s, t, ["k"])
    assert (known.count(), unknown.count()) == (1, 2)


def test_contains_takes_wildcards_as_they_are_and_snippets_cut(spark):
    d = spark.createDataFrame([("100% sure",), ("1000 sure",)], "t string")
    assert rows(d.where(relations.contains(F.col("t"), "0%"))) == [("100% sure",)]
    long = spark.createDataFrame([("x" * 100 + "HIT" + "y" * 200,), ("z" * 250,), ("hit",)], "t string")
    assert [r[0] for r in long.select(relations.snippet(F.col("t"), "hit")).collect()] == ["..." + "x" * 80 + "HIT" + "y" * 120 + "...", "z" * 200 + "...", "hit"]


def test_interval_union_and_gaps_against_a_plain_version(spark):
    rng = random.Random(4)
    spans = [(k, s := rng.randrange(100), s + rng.randrange(1, 9)) for k in range(3) for _ in range(20)]
    got = rows(intervals.union(spark.createDataFrame(spans, "k int, start_pos int, end_pos int"), ["k"]))
    want = []
    for k in range(3):
        merged = []
        for _, s, e in sorted(x for x in spans if x[0] == k):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want += [(k, s, e) for s, e in merged]
    assert got == sorted(want, key=str)


def test_overlapping_pairs_once_each(spark):
    rng = random.Random(5)
    make = lambda: [(i, s := rng.randrange(1000), s + rng.randrange(1, 700)) for i in range(30)]
    a, b = make(), make()
    kind = "i int, start_pos int, end_pos int"
    left, right = (spark.createDataFrame(x, kind).withColumn("k", F.lit(1)) for x in (a, b))
    got = rows(intervals.overlapping(left, right, ["k"], width=64).select("i", "i_b"))
    assert got == sorted(((x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])), key=str)


def test_streak_skips_pending_and_stops_at_the_first_failure(spark):
    d = spark.createDataFrame([(1, t, s) for t, s in enumerate("ARAPA")] + [(2, 0, "R")], "k int, t int, s string")
    assert rows(intervals.streak(d, ["k"], [F.desc("t")], "s = 'A'", "s = 'P'")) == [(1, 2), (2, 0)]


@pytest.mark.parametrize(("body", "old", "new", "want"), [("a b  c", "b c", "X", "a X"), ("a B c", "b", "X", "a X c"), ("b b", "b", "X", "X b"), ("a", "z", "X", None), ("a", " ", "X", None), ("f(x)+1", "f(x)+1", "$1", "$1")])
def test_first_replacement_in_python_and_in_columns(spark, body, old, new, want):
    assert apply.find_and_replace(body, old, new) == want
    d = spark.createDataFrame([(body, old, new)], "t string, o string, n string")
    assert d.select(text.first_replaced(F.col("t"), F.col("o"), F.col("n"))["text"]).first()[0] == want


def test_changes_fold_in_order_and_stop_at_a_repeal(spark):
    states = spark.createDataFrame([(26, "401", "The rate is 5 percent."), (26, "402", "x")], "title_number int, section_number string, text_content string")
    kind = "change_id long, title_number int, section_number string, change_type string, old_text string, new_text string"
    changes = spark.createDataFrame([(1, 26, "401", "Modify", "5 percent", "10 percent"), (2, 26, "401", "Add", None, "New line."), (3, 26, "402", "Repeal", None, None), (4, 26, "402", "Add", None, "late"), (5, 26, "403", "Add", None, "fresh"), (6, 26, "401", "Transfer", None, None), (7, 26, "401", "Delete", "absent", None)], kind)
    out = {r["section_number"]: r for r in apply.apply_changes(states, changes).collect()}
    assert out["401"]["text_content"] == "The rate is 10 percent.\nNew line."
    assert (out["401"]["applied"], out["401"]["skipped"], out["401"]["failed"]) == (2, 1, 1)
    assert out["402"]["is_deleted"] and out["402"]["text_content"] is None and out["402"]["applied"] == 1
    assert out["403"]["text_content"] == "fresh"


def test_play_forward_orders_by_law(spark):
    states = spark.createDataFrame([(1, "1", "a")], "title_number int, section_number string, text_content string")
    laws = spark.createDataFrame([(10, 115, "9", date(2018, 1, 1)), (11, 115, "10", date(2018, 1, 1)), (12, 114, "1", None)], "law_id long, congress int, law_number string, enacted_date date")
    changes = spark.createDataFrame([(1, 11, 1, "1", "Modify", "c", "d"), (2, 10, 1, "1", "Modify", "b", "c"), (3, 12, 1, "1", "Modify", "a", "b")], "change_id long, law_id long, title_number int, section_number string, change_type string, old_text string, new_text string")
    assert apply.play_forward(states, changes, laws).first()["text_content"] == "d"


def test_hunks_give_back_the_new_text():
    a, b = "\n".join(map(str, range(30))), "\n".join(str(k) for k in range(30) if k != 7) + "\nend"
    out = apply.hunks_of(a, b)
    assert {x[0] for x in out} == {0, 1}
    assert [x[6] for x in out if x[5] == "-"] == ["7"] and [x[6] for x in out if x[5] == "+"] == ["end"]
    assert apply.hunks_of("x", "x") == []


def test_extraction_finds_typed_edits_with_references(spark):
    law = 'Section 219(c) of title 26, United States Code, is amended by striking "5 percent" and inserting "10 percent". Section 12 of title 17 is hereby repealed. Other text that nobody claims stands here.'
    d = spark.createDataFrame([(1, law), (2, None), (3, "")], "law_id long, text string")
    got = extract.extract_edits(d).orderBy("start_pos").collect()
    assert [(r["pattern_name"], r["change_type"], r["title_number"], r["section_number"], r["old_text"], r["new_text"]) for r in got] == [("strike_insert", "Modify", 26, "219", "5 percent", "10 percent"), ("repeal", "Repeal", 17, "12", None, None)]
    share = {r["law_id"]: r["coverage"] for r in extract.coverage(d, extract.extract_edits(d)).collect()}
    assert 20 < share[1] < 90 and share[3] == 0
    assert any("nobody claims" in r["gap_text"] for r in extract.unclaimed(d, extract.extract_edits(d)).collect())


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert tuple(one(text.citation(F.lit("17 U.S.C. § 106")))) == (17, "106") and tuple(one(text.citation(F.lit("17/106a")))) == (17, "106a")
    assert tuple(one(text.usc_reference(F.lit("/us/usc/t26/s219/c/1")))) == (26, "219", "(c)(1)")
    assert one(text.release_point(F.lit("119-72not60u1"))).asDict() == {"congress": 119, "law_number": 72, "not_laws": [60], "update_number": 1}
    assert [one(text.indent_level(F.lit(m))) for m in ("a", "1", "A", "ii", "II", "i")] == [1, 2, 3, 4, 5, 1]
    assert tuple(one(text.vote_tally(F.lit("passed 218–210")))) == (218, 210)
    assert one(text.public_laws(F.lit("Pub. L. 115-97 and Public Law 94-553; Pub. L. 115-97"))) == ["115-97", "94-553"]
    assert one(text.slug(F.lit("A — Title: 1!"))) == "a-title-1" and one(text.spaced_title(F.lit("effectiveDate"))) == "Effective Date"
    assert [one(dates.prose_date(F.lit(x))) for x in ("Oct. 19, 1976", "1976-10-19", "Sept. 3, 2001", "Feb. 30, 2001", "no")] == [date(1976, 10, 19), date(1976, 10, 19), date(2001, 9, 3), None, None]
    assert one(dates.congress_of(F.lit("2021-01-02").cast("date"))) == 116 and one(dates.display_date(F.lit("1935-08-14").cast("date"))) == "Aug. 14, 1935"


LAW = """<law xmlns="http://schemas.gpo.gov/xml/uslm"><section role="instruction"><chapeau>Section <ref href="/us/usc/t26/s219/c"/> is <amendingAction type="amend">amended</amendingAction>—</chapeau>
<paragraph>by <amendingAction type="delete">striking</amendingAction> <quotedText>5 percent</quotedText> each place it appears and <amendingAction type="insert">inserting</amendingAction> <quotedText>10 percent</quotedText>;</paragraph>
<paragraph>by <amendingAction type="add">adding</amendingAction> at the end <quotedContent>(3) New.</quotedContent></paragraph></section>
<section role="instruction">Section <ref href="/us/usc/t17/s5"/> is <amendingAction type="repeal">repealed</amendingAction>.</section>
<section><sidenote>16 USC 797 note.</sidenote><num>4</num><content>Short title.</content></section></law>"""


def test_xml_instructions_become_edits(spark):
    from palimpsest.operators import xml_edits

    got = [r[:9] for r in xml_edits.edits_of(LAW)]
    assert got == [
        ("Modify", 26, "219", "(c)", "5 percent", "10 percent", "each_place", 0.98, False), ("Add", 26, "219", "(c)", None, "(3) New.", "at_end", 0.95, False),
        ("Repeal", 17, "5", None, None, None, None, 0.9, False), ("Add_Note", 16, "797", None, None, "Short title.", None, 1.0, True),
    ]
    d = spark.createDataFrame([(1, LAW), (2, "<a>"), (3, None)], "law_id long, xml string")
    assert xml_edits.extract_xml_edits(d).count() == 4


def test_lines_are_patched_in_place():
    from palimpsest.operators.provisions import before_in_sequence, patch

    lines = ["(a) one", "\t(1) deep", "(b) two", "(d) four"]
    assert patch(lines, [("Add", None, "(c) three"), ("Redesignate", "(d)", "(e)"), ("Modify", "two", "2"), ("Delete", "(a)", None)]) == ["(b) 2", "(c) three", "(e) four"]
    assert patch(lines, [("Add", None, "(z) last")])[-1] == "(z) last"
    assert [before_in_sequence(m) for m in ("b", "a", "3", "1", "iv")] == ["a", None, "2", None, None]


def test_notes_are_added_once(spark):
    from palimpsest.operators.provisions import with_note

    kind = "array<struct<law:string,year:int,lines:array<string>>>"
    d = spark.createDataFrame([(None,), ([("1-1", 1990, ["x"])],), ([("2-2", 2000, ["y"])],)], f"notes {kind}")
    got = [r[0] for r in d.select(with_note(F.col("notes"), F.lit("2-2"), F.lit(2000), F.lit("a\n\nb"))).collect()]
    assert [[n["law"] for n in x] for x in got] == [["2-2"], ["1-1", "2-2"], ["2-2"]] and got[0][0]["lines"] == ["a", "b"]


def test_ranges_by_broadcast_and_by_cells(spark, monkeypatch):
    days = spark.range(0, 3000, 7).select(F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    ranges = spark.createDataFrame([("A", date(1995, 2, 1), date(1998, 1, 1)), ("B", date(1998, 1, 2), date(1998, 1, 30)), ("C", date(2001, 1, 1), date(2020, 1, 1))], "l string, a date, b date")
    few = rows(relations.range_label(days, "d", ranges, "a", "b", "l", "none"))
    monkeypatch.setattr(relations, "MOST_RANGES", 2)
    assert rows(relations.range_label(days, "d", ranges, "a", "b", "l", "none")) == few
    assert {x for _, x in few} == {"A", "B", "C", "none"}


EDITS = [
    ('by striking "AFDC" each place such term appears and inserting "TANF"', "strike_insert_each_place", "Modify", "AFDC", "TANF"),
    ('by striking "AFDC" each place it appears', "strike_insert_each_place", "Modify", "AFDC", None),
    ("by striking out ``ten days'' and inserting in lieu thereof ``the lender's days''", "strike_insert", "Modify", "ten days", "the lender's days"),
    ('by striking the words "tax year" and inserting "plan year"', "strike_insert_phrase", "Modify", "tax year", "plan year"),
    ('by striking everything before "the term" and inserting "In this part,"', "strike_insert_everything_before", "Modify", "the term", "In this part,"),
    ('by striking everything after "Secretary" and inserting a period', "strike_insert_everything_after", "Modify", "Secretary", None),
    ('by striking "or (5)"', "strike", "Delete", "or (5)", None),
    ('by striking "unless" and all that follows through the semicolon', "strike_through_period", "Delete", "unless", None),
    ("by striking paragraph (4)", "strike_paragraph", "Delete", None, None),
    ('by striking "but only" and everything that follows', "strike_and_following", "Delete", "but only", None),
    ("by adding at the end thereof the following new subsection: ``(h) New.''", "add_at_end", "Add", None, "(h) New."),
    ("by inserting after paragraph (8) the following", "add_after_paragraph", "Add", None, None),
    ("by inserting after section 411 the following new section", "insert_after_section", "Add", None, None),
    ('by inserting before "the date" the following: "the earlier of"', "insert_before", "Add", None, "the earlier of"),
    ("by inserting before clause (ii) the following new clause", "insert_before_paragraph", "Add", None, None),
    ("by adding new paragraph (9) as follows", "add_new_subsection", "Add", None, None),
    (". Section 963 (old) is hereby repealed", "repeal", "Repeal", None, None),
    (". Subparagraph (B) is hereby stricken", "paragraph_repealed", "Repeal", None, None),
    (". Paragraph (3) of section 77 is repealed", "paragraph_repealed", "Repeal", None, None),
    ("by striking section 1256(e)(3)(C)", "striking_section", "Repeal", None, None),
    ("by redesignating section 45R as section 45S", "redesignate_section", "Redesignate", "45R", "45S"),
    ("by redesignating clauses (i), (ii), and (iii) as clauses (ii), (iii), and (iv)", "redesignate_paragraph", "Redesignate", "(i), (ii), and (iii)", "(ii), (iii), and (iv)"),
    ('. Section 505(b)(5) is hereby amended and reenacted to read as follows: "' + "long " * 900 + '"', "substitute_section", "Modify", None, "long " * 900),
    (". Clause (ii) is hereby amended to read as follows", "substitute_subsection", "Modify", None, None),
    (". Section 1148 is hereby transferred to section 234 of title 42", "transfer", "Transfer", None, None),
    (". Section 512 of title 17, United States Code, is amended in the heading", "section_amended_general", "Modify", None, None),
    (". Section 512 of title 17, United States Code, is amended by the Act", "section_amended_by", "Modify", None, None),
    (". Subsection (d) of such section is amended", "subsection_amended", "Modify", None, None),
    (". Title 42, United States Code, is hereby amended", "title_amended", "Modify", None, None),
    (". Title 18, United States Code, is amended by adding a new section 2323", "add_new_section", "Add", None, None),
    (". Chapter 12 of title 17, United States Code, is amended by adding at the end the following new section", "chapter_amended_add_section", "Add", None, None),
]


@pytest.mark.parametrize(("said", "name", "change", "old", "new"), EDITS, ids=[f"{x[1]}-{k}" for k, x in enumerate(EDITS)])
def test_each_pattern_finds_its_edit(said, name, change, old, new):
    got = [r for r in extract._matches(f"Section 9 of title 26 is amended {said}. The rest stands.") if r[8] > 0]
    assert [(r[0], r[1], r[5], r[6]) for r in got] == [(name, change, old, new)]


def test_all_patterns_of_the_reference_are_there():
    names = """strike_insert strike_insert_each_place strike_insert_phrase strike_insert_everything_before strike_insert_everything_after strike strike_through_period strike_paragraph
    strike_and_following add_at_end add_after_paragraph insert_after_section insert_before insert_before_paragraph add_new_subsection repeal paragraph_repealed striking_section redesignate_section
    redesignate_paragraph substitute_section substitute_subsection transfer section_amended_general section_amended_by subsection_amended title_amended add_new_section chapter_amended_add_section""".split()
    assert len(names) == 29 and set(names) <= set(extract.PATTERNS) and {n for n in names} - {x[1] for x in EDITS} == set()


def test_marks_and_reviews_of_edits():
    one = lambda t: [r for r in extract._matches(t) if r[0] not in extract._FRAMES][0]
    r = one("Section 219(c) of title 26 is amended by striking paragraph (4).")
    assert (r[2], r[3], r[4], r[10]) == (26, "219", "(c)(4)", True)
    assert one('Section 219 of title 26 is amended by striking "219" and inserting "220".')[5:7] == ("219", "220")
    assert one('Section 5 of title 26 is amended by striking all that follows "A" and inserting "B".')[10]
    assert [r[3] for r in extract._matches("Section 5 of the Act stays and section 6 is repealed.")] == ["6"]


def test_closures_end_in_loops(spark):
    from palimpsest.operators import relations

    nodes = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "c")], "id string, parent_id string")
    assert {(r["ancestor"], r["descendant"]) for r in relations.closure(nodes).collect()} >= {("a", "d"), ("c", "a"), ("b", "c")}
    assert {r["id"]: r["depth"] for r in relations.descendants(nodes, "a").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_citations_and_notes_without_what_they_look_for(spark):
    from palimpsest.functions import citations

    rows = [("nothing",), ("Pub. L. 94-553; Pub. L. 100–1, title I.",), ("(Pub. L. 94–553, § 3(d)",), ("",), (None,), ("—Act June 23, 1947, restated it.",), ("1990—no law.",), ("1951—See Act of then.",)]
    t = F.col("t")
    got = spark.createDataFrame(rows, "t string").select("t", F.size(citations.law_citations(t)).alias("n"), citations.amendments(t).alias("a"), citations.first_amendment(t).alias("f")).collect()
    assert [r["n"] for r in got][:4] == [0, 2, 1, 0]
    assert [[(a["year"], a["congress"]) for a in r["a"] or []] for r in got] == [[], [], [], [], [], [(1947, None)], [], [(1951, None)]]
    assert all(r["f"] is None for r in got)


def test_headings(spark):
    from palimpsest.functions import headings

    cases = {"THE ACT OF A CROSS-BORDER STATE": "The Act of a Cross-Border State", "Mixed Case OF it": "Mixed Case OF it", "12": "12"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", headings.title_cased(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == cases
    got = spark.createDataFrame([("no dash",), ("One two three four five six seven—x",), ("It ends.—x",), ("Definitions—The term",)], "t string").select(headings.split_header(F.col("t")).alias("x")).collect()
    assert [r["x"]["header"] for r in got] == [None, None, None, "Definitions"]


def test_playing_to_a_release_point_that_is_not_ahead(spark):
    from palimpsest.operators import chrono, relations

    rows = [("public_law", "L1", 1, 1, "2000-01-01"), ("release_point", "R1", 1, None, "2000-01-01"), ("public_law", "L2", 1, 2, None), ("release_point", "R2", 1, None, "2001-01-01")]
    e = spark.createDataFrame(rows, "event_type string, identifier string, congress int, law_number int, day string").withColumn("event_date", F.col("day").cast("date")).drop("day")
    events = relations.timeline(e.where("event_type = 'public_law'"), e.where("event_type = 'release_point'"))
    assert [r["identifier"] for r in chrono.next_events(events, "L2", 5).collect()] == ["L1", "R1", "R2"]
    assert chrono.pending_events(events, "unknown").count() == 4
    assert {r["identifier"] for r in chrono.events_until(events, "L1", "R2").collect()} == {"R1", "R2"}
    with pytest.raises(KeyError):
        chrono.events_until(events, "R2", "R1")


def test_rules_without_rule_x(spark):
    from palimpsest.operators import committees

    assert committees.rule_x("<p>RULE IX</p><p>(a) Committee on X.</p>") == []
    assert committees.rule_x("<p>Rule X.</p><p>(a) Committee on the Budget.</p><p>(b) Permanent Select Committee on Intelligence.</p><p>(1) Spies.</p>") == [("a", "Committee on the Budget", 0, ""), ("b", "Permanent Select Committee on Intelligence", 1, "Spies.")]


def test_following_text_of_odd_instructions(spark):
    from palimpsest.operators import prose

    rows = [("x: “never closed. ” and more",), ("x:",), ("",), (None,), ("x nothing quoted and no paragraph",), ('x "short"',)]
    got = spark.createDataFrame(rows, "t string").select(prose.following_text(F.col("t"), F.lit(1)).alias("f")).collect()
    assert [r["f"] and (r["f"]["text"], r["f"]["confidence"]) for r in got] == [("never closed.", 0.9), None, None, None, None, ("short", 0.9)]


def test_sentences_of_empty_texts(spark):
    from palimpsest.operators import prose

    d = spark.createDataFrame([(1, ""), (2, None), (3, "One."), (4, "A v. B is cited. “So it is.” Then\n\n\nmore")], "k int, t string")
    got = prose.sentences(d, ["k"], "t").orderBy("k", "position").collect()
    assert [(r["k"], r["sentence"], r["paragraph"]) for r in got] == [(3, "One.", 0), (4, "A v. B is cited.", 0), (4, "“So it is.” Then", 0), (4, "more", 1)]
    texts = {3: "One.", 4: "A v. B is cited. “So it is.” Then\n\n\nmore"}
    assert all(texts[r["k"]][r["start_char"] : r["end_char"]] == r["sentence"] for r in got)


def test_laws_are_processed_once(spark):
    from palimpsest.operators import process

    laws = spark.createDataFrame([(1, "Section 5 of title 3 is hereby repealed."), (2, None), (3, "Section 9 is amended by striking \"a\" and inserting \"b\".")], "law_id int, text string")
    none = spark.createDataFrame([], "law_id int")
    changes, sessions = process.process_laws(laws, none, F.lit(None).cast("int"))
    assert {(r["law_id"], r["status"], r["error"]) for r in changes.collect()} == {(1, "made", None), (3, "unresolved", "no title")}
    assert {r["law_id"] for r in sessions.collect()} == {1, 2, 3}
    again, _ = process.process_laws(laws, laws.select("law_id"), F.lit(26))
    assert again.count() == 0


def test_intake_of_the_same_rows_changes_nothing(spark):
    from palimpsest.operators import intake

    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    out, log = intake.taken_in(d, d, ["k"])
    assert tuple(log.first()) == (2, 0, 0, 2) and sorted(map(tuple, out.collect())) == [(1, "a"), (2, None)]
    assert tuple(intake.taken_in(d, d, ["k"], force=True)[1].first()) == (2, 0, 2, 0)
    r = spark.createDataFrame([(1, 1, False, "Ingesting")], "revision_id long, sequence_number long, is_ground_truth boolean, status string")
    assert intake.finalized(r).first()["status"] == "Ingesting"


def test_notes_of_empty_and_flat_notes(spark):
    from palimpsest.operators import notes

    raw = "[NH]Amendments[/NH]1990—Pub. L. 101–5 struck out all of it.[NH]Derivation[/NH][NH]Amendments[/NH]again, and long enough to be kept[NH]House Report No. 94–1476[/NH]It says what it says about all of it."
    d = spark.createDataFrame([(1, raw), (2, ""), (3, None)], "k int, raw_notes string")
    got = {r["k"]: r for r in notes.notes_document(d, ["k"]).collect()}
    assert [(n["category"], n["header"]) for n in got[1]["notes"]] == [("editorial", "Amendments"), ("historical", "Derivation"), ("historical", "House Report No. 94–1476")]
    assert got[1]["first_amendment"]["law"] == "PL 101-5" and got[1]["has_amendments"]
    assert not got[2]["notes"] and not got[2]["has_amendments"] and got[2]["amendments"] == []
