from pyspark.sql import functions as F

from palimpsest.sources import sinks, tables, uslm
from palimpsest.streaming import incremental

XML = """<uslm xmlns="http://schemas.gpo.gov/xml/uslm"><main><title><num value="17">Title 17—</num><heading>COPYRIGHTS</heading>
<chapter><num value="1">CHAPTER 1—</num><heading>SUBJECT MATTER</heading>
<section><num value="101">§ 101.</num><heading>Definitions</heading><chapeau>In this title:</chapeau>
<subsection><num value="a">(a)</num><content>First.</content><paragraph><num value="1">(1)</num><content>Deep.</content></paragraph></subsection></section>
<section role="instruction"><num value="9"/></section></chapter></title></main></uslm>"""


def test_titles_become_sections_and_groups(spark):
    files = spark.createDataFrame([("t17.xml", XML), ("bad.xml", "<a>"), ("null.xml", None)], "path string, text string")
    got = uslm.parse_sections(files).collect()
    assert [(r["title_number"], r["section_number"], r["heading"], r["group_key"]) for r in got] == [(17, "101", "Definitions", "title:17/chapter:1")]
    assert got[0]["text_content"] == "In this title:\n(a) First.\n\t(1) Deep."
    assert [(r["group_key"], r["name"]) for r in uslm.parse_groups(files).orderBy("sort_order").collect()] == [("title:17", "COPYRIGHTS"), ("title:17/chapter:1", "SUBJECT MATTER")]


def test_release_point_links(spark):
    html = '<a href="usc-rp@113-21.htm">Public Law 113-21 (07/18/2013), titles 42, 5</a><a href="usc-rp@119-72not60.htm">x</a><a href="usc-rp@113-21.htm">again</a>'
    got = {r["full_identifier"]: r for r in tables.release_point_links(spark.createDataFrame([(html,)], "html string")).collect()}
    assert set(got) == {"113-21", "119-72not60"} and got["113-21"]["titles"] == [5, 42] and got["119-72not60"]["not_laws"] == [60]


def test_versioned_table_and_stream(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() == 0
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert t.version() == 2 and sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    spark.createDataFrame([(3, "e"), (4, "f")], "k int, v string").write.parquet(str(tmp_path / "in"))
    stream = incremental.files(spark, str(tmp_path / "in"), t.read().schema)
    incremental.ingest(stream, t, ["k"], str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "e"), (4, "f")]


def test_appended_batches_keep_the_newest_row(spark, tmp_path):
    t = incremental.NewestRows(spark, str(tmp_path / "t"), ["k"])
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    for n in range(2):
        stream = incremental.files(spark, str(tmp_path / "in"), spark.createDataFrame([], "k int, v string").schema)
        incremental.append(stream, t, str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(2, "c"), (3, None)], "k int, v string").write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, t.read().collect()), key=str) == [(1, "a"), (2, "c"), (3, None)]
    assert sorted(map(tuple, t.compact(str(tmp_path / "c")).read().collect()), key=str) == [(1, "a"), (2, "c"), (3, None)]


def test_windowed_counts_are_final_after_the_watermark(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-03 01:00:00', 'a'")
    rows.write.parquet(str(tmp_path / "in"))
    out = incremental.windowed_counts(incremental.files(spark, str(tmp_path / "in"), rows.schema))
    q = out.writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("w").where(F.col("n") == 1).count() == 1


def test_revision_status_changes_only_where_allowed(spark):
    d = spark.createDataFrame([(1, "Ingesting"), (2, "Failed")], "revision_id long, status string")
    assert sorted(map(tuple, sinks.status_after(sinks.status_after(d, 1, "Ingested"), 2, "Ingested").collect())) == [(1, "Ingested"), (2, "Failed")]

NOTES = """<uslm xmlns="http://schemas.gpo.gov/xml/uslm"><main><title identifier="/us/usc/t5"><num value="5"/><chapter identifier="/us/usc/t5/ch1">
<section><num value="7">§ 7.</num><heading>Rules<ref class="footnoteRef">1</ref><note type="footnote"><num>1</num> So in original.</note></heading><content>Text of <ref href="/us/usc/t17/s106">section 106</ref>(a)(1) of it.</content>
<sourceCredit>(<ref href="/us/pl/94/553">Pub. L. 94–553</ref>, § 3 .)</sourceCredit>
<notes><note><heading>Editorial Notes</heading></note><note><heading>Amendments</heading><p>1990—<ref href="/us/pl/101/5">Pub. L. 101–5</ref> struck out some of it.</p></note>
<note><heading>Effective Date</heading><p>It says: <quotedContent>Words</quotedContent></p><signature>A. B.</signature></note></notes></section></chapter></title></main></uslm>"""


def test_notes_of_sections(spark):
    from palimpsest.operators import notes
    from palimpsest.sources import uslm_notes

    files = spark.createDataFrame([("t5.xml", NOTES), ("bad.xml", "<a>"), ("null.xml", None)], "path string, text string")
    got = uslm_notes.complete_notes(uslm_notes.section_notes(files)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["title_number"], r["section_number"], r["heading"], r["source_credit"]) == (5, "7", "Rules", "(Pub. L. 94–553, § 3.)")
    assert r["footnotes"] == ["1 So in original."] and [x["level"] for x in r["levels"]] == ["title", "chapter"]
    assert [(x["kind"], x["suffix"], x["note"]) for x in r["refs"]] == [("usc_section", "(a)(1)", None), ("public_law", "", None), ("public_law", "", "Amendments")]
    assert "[NH]Amendments[/NH] 1990—Pub. L. 101–5 struck out some of it.[PARA]" in r["raw_notes"] and "[QC:1]Words[/QC]" in r["raw_notes"] and "[SIG]A. B.[/SIG]" in r["raw_notes"]
    assert {x["path"] for x in uslm_notes.rejected_files(files).collect()} == {"bad.xml", "null.xml"}
    doc = notes.notes_document(uslm_notes.complete_notes(uslm_notes.section_notes(files)), ["section_number"], "notes_text").collect()[0]
    assert [(c["congress"], c["law_number"]) for c in doc["citations"]] == [(94, 553)] and [(a["year"], a["congress"]) for a in doc["amendments"]] == [(1990, 101)]


def title_file(n):
    """A title of n sections in chapters, some of which quote whole sections."""
    out = ['<?xml version="1.0"?><!DOCTYPE uscDoc><uscDoc xmlns="http://xml.house.gov/schemas/uslm/1.0" xmlns:dc="http://purl.org/dc/elements/1.1/" identifier="/us/usc/t17"><meta><dc:title>x</dc:title><docNumber>17</docNumber></meta><main><title identifier="/us/usc/t17"><num value="17">Title 17—</num><heading>COPYRIGHTS</heading>']
    for k in range(1, n + 1):
        if k % 10 == 1:
            out.append(("</chapter>" if k > 1 else "") + f'<chapter identifier="/us/usc/t17/ch{k}"><num value="{k}">CHAPTER {k}—</num><heading>Part {k} &amp; more<ref class="footnoteRef">1</ref><note type="footnote">no</note></heading>')
        inner = f'<notes><note><quotedContent><section><num>1</num><content>“quoted {k}”</content></section></quotedContent></note></notes>' if k % 7 == 0 else ""
        out.append(
            f'<section style="x" identifier="/us/usc/t17/s{k}"><num value="{k}">§ {k}.</num><heading>Head {k}</heading><chapeau>Of {k}<ref class="footnoteRef">1</ref><note type="footnote"><num>1</num> So in original.</note> :</chapeau>'
            f'<subsection><num value="a">(a)</num><heading>In general</heading><content>First {k} , “é”. {"words " * (k % 50)}</content></subsection><subsection><num value="b">(b)</num><chapeau>If</chapeau><paragraph><num value="1">(1)</num><content>deep<continuation>flush</continuation></content></paragraph><continuation>closes.</continuation></subsection>{inner}</section>'
        )
    return "".join(out) + "</chapter></title></main></uscDoc>"


def test_large_titles_are_read_by_many_tasks(spark, tmp_path):
    from palimpsest.operators import line_tree
    from palimpsest.sources import uslm_stream

    n = 400
    (tmp_path / "t17.xml").write_text(title_file(n))
    (tmp_path / "none.xml").write_text("<uscDoc><main/></uscDoc>")
    (tmp_path / "empty.xml").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = uslm_stream.sections(spark, str(tmp_path))
        rows = got.orderBy("path", "block", "n").collect()
        assert len({r["block"] for r in rows}) > 5
        assert [r["section_number"] for r in rows] == [str(k) for k in range(1, n + 1)]
        files = spark.createDataFrame([("t17.xml", (tmp_path / "t17.xml").read_text())], "path string, text string")
        whole = {r["section_number"]: r for r in uslm.parse_sections(files).collect()}
        assert set(whole) == {r["section_number"] for r in rows} and all(whole[r["section_number"]]["heading"] == r["heading"] and r["title_number"] == 17 for r in rows)
        r = rows[6]
        assert r["text_content"] == f"Of 7[1]:\n(a) In general First 7, “é”. {'words ' * 7}".rstrip() + "\n(b) If\n\t(1) deep\nflush\ncloses." and r["footnotes"] == ["1 So in original."]
        lines = line_tree.section_lines(got.where("section_number = '7'"), ["section_number"], levels="levels").orderBy("line_number").collect()
        assert [(x["content"], x["indent_level"]) for x in lines if x["content"]] == [("Of 7[1]:", 0), ("(a) In general", 0), ("First 7, “é”. words words words words words words words", 1), ("(b) If", 0), ("(1) deep", 1), ("flush", 0), ("closes.", 0)]
        one = uslm_stream.sections(spark, str(tmp_path), title=17, section="14").collect()
        assert [(x["section_number"], x["text_hash"]) for x in one] == [("14", rows[13]["text_hash"])] and uslm_stream.sections(spark, str(tmp_path), title=18).count() == 0
        outline = uslm_stream.groups(spark, str(tmp_path)).where("group_type IS NOT NULL").orderBy("sort_order").collect()
        want = uslm.parse_groups(files).orderBy("sort_order").collect()
        assert [(x["group_key"], x["parent_key"], x["name"]) for x in outline] == [(x["group_key"], x["parent_key"], x["name"]) for x in want]
        inside = {x["n"]: x["group_key"] for x in uslm_stream.groups(spark, str(tmp_path)).where("group_type IS NULL").join(got.where("section_number = '25'"), ["path", "block", "n"]).collect()}
        assert set(inside.values()) == {"title:17/chapter:21"}
        assert uslm_stream.broken(spark, str(tmp_path)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_titles_of_other_forms(spark):
    foot = '<uslm><meta><docNumber> 5 </docNumber><property role="is-positive-law">yes</property></meta><body><level role="chapter"><num value="1"/><heading>ONE</heading><section><num value="7">§ 7.</num><heading>Def<ref class="footnoteRef">1</ref><note type="footnote"><num>1</num>So in original.</note> [</heading><content>Text<ref class="footnoteRef">1</ref><note type="footnote">foot body</note> of section .</content></section></level></body></uslm>'
    files = spark.createDataFrame([("a", foot), ("b", '<x number="9"><section><num>1</num></section></x>'), ("c", '<x identifier="/us/usc/t18"><chapter><num>2</num></chapter></x>'), ("d", "<x><section><num>3</num></section></x>")], "path string, text string")
    got = {r["path"]: r for r in uslm.parse_sections(files).collect()}
    assert (got["a"]["heading"], got["a"]["text_content"], got["a"]["title_number"], got["a"]["group_key"]) == ("Def", "Text[1] of section.", 5, "title:5/chapter:1")
    assert (got["b"]["title_number"], got["d"]["title_number"], got["d"]["group_key"]) == (9, None, None)
    named = {(r["path"], r["group_key"]): r["name"] for r in uslm.parse_groups(files).collect()}
    assert named[("b", "title:9")] == "Title 9" and ("c", "title:18/chapter:2") in named
    from xml.etree import ElementTree

    assert uslm.title_of(ElementTree.fromstring(foot))[::2] == (5, True) and uslm.title_of(ElementTree.fromstring("<x/>")) == (None, "Title 0", False)
