"""Queries of citations, notes, headings, bills' histories, committees and play-forward, over the driver's tables in these roles.

Texts to be read are written from columns of the tables; the SQL gives what reading must find from the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, headings
from ..functions.text import en_dashed, indent_level, is_roman, plain_dashed, public_laws, release_point, slug, spaced_title, usc_reference
from ..functions.text import chamber as chamber_of
from ..functions.text import citation, edit_words, first_replaced, full_name, party, shortened
from ..functions.dates import display_date, first_year, prose_date
from ..operators.lineage import spread
from ..operators import apply, catalog, chrono, committees, history, intake, intervals, maintenance, notes, process, prose, relations, viewer
from ..sources.tables import release_point_links, table
from . import standins
from .queries import _ALL_EVENTS, _all_events, query

said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Citations and notes

_ORDER = "o_custkey % 20 + 95 AS congress, o_orderkey % 900 + 1 AS law, o_orderkey % 300 + 1 AS sec, o_custkey % 3000 + 1 AS page, o_orderkey % 60 + 1960 AS year"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "orders")).selectExpr("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", *_ORDER.split(", "))


@query(f"""WITH o AS (SELECT o_orderkey, {_ORDER} FROM orders)
SELECT o_orderkey, 0 AS position, CAST(congress AS INTEGER) AS congress, CAST(law AS INTEGER) AS law_number, 'title IV/§' || sec || '(b)(2)' AS path, '(c)' AS extra, 'Oct. 19, 1976' AS date_text, '90' AS stat_volume, CAST(page AS INTEGER) AS stat_page, CAST(page + 7 AS VARCHAR) AS pages FROM o
UNION ALL SELECT o_orderkey, 1, 104, CAST(law AS INTEGER), 'div. C/§3', '', NULL, '110', 9, '' FROM o""")
def law_citations(spark: SparkSession, d: str) -> DataFrame:
    """Source credits of two laws, nested parentheses and all, read back into their parts."""
    text = said("Whatever it says (of this). ( Pub. L. ", F.col("congress"), "–", F.col("law"), ", title IV, § ", F.col("sec"), "(b)(2), (c), Oct. 19, 1976, 90 Stat. ", F.col("page"), ", ", F.col("page") + 7, " ; Pub. L. 104–", F.col("law"), ", div. C, § 3, 110 Stat. 9 .) See Pub. L. 1–1.")
    rows = _orders(spark, d).select("o_orderkey", F.posexplode(citations.law_citations(text)).alias("position", "c"))
    joined = lambda c, by: F.array_join(c, by)
    return rows.select(
        "o_orderkey", "position", "c.congress", "c.law_number", joined(citations.level_display(F.col("c.path")), "/").alias("path"), joined("c.extra_sections", ",").alias("extra"),
        "c.date_text", "c.stat_volume", "c.stat_page", joined(F.transform("c.extra_pages", lambda x: x.cast("string")), ",").alias("pages"),
    )


@query(f"""WITH o AS (SELECT o_orderkey, {_ORDER} FROM orders)
SELECT o_orderkey, 0 AS position, CAST(year AS INTEGER) AS year, CAST(congress AS INTEGER) AS congress, CAST(law AS INTEGER) AS law_number, 'Dec. 9, 2010' AS date_text, CAST(page AS INTEGER) AS stat_page, 'Subsec. (e). Pub. L. ' || congress || '–' || law || ', § 3(a), Dec. 9, 2010, 124 Stat. ' || page || ', struck out "two words".' AS description FROM o
UNION ALL SELECT o_orderkey, 1, CAST(year AS INTEGER), CAST(congress AS INTEGER), CAST(law + 1 AS INTEGER), NULL, NULL, 'Pub. L. ' || congress || '–' || (law + 1) || ' added it without regard to Pub. L. 94–171.' FROM o
UNION ALL SELECT o_orderkey, 2, 1951, NULL, NULL, NULL, NULL, 'Act Oct. 31, 1951, ch. 655, restated section ' || sec || '.' FROM o""")
def note_amendments(spark: SparkSession, d: str) -> DataFrame:
    """Notes that list amendments by year, with laws in the middle of sentences and an act from before laws had numbers."""
    law = lambda n: said("Pub. L. ", F.col("congress"), "–", n)
    text = said(F.col("year"), "—Subsec. (e). ", law(F.col("law")), ", § 3(a), Dec. 9, 2010, 124 Stat. ", F.col("page"), ',  struck out " two words ".\n\n', law(F.col("law") + 1), " added it without regard to Pub. L. 94–171.\n\n1951—Act Oct. 31, 1951, ch. 655, restated section ", F.col("sec"), ".")
    rows = _orders(spark, d).select("o_orderkey", F.posexplode(citations.amendments(text)).alias("position", "a"))
    return rows.select("o_orderkey", "position", "a.year", "a.congress", "a.law_number", "a.date_text", "a.stat_page", "a.description")


@query(f"""WITH o AS (SELECT o_orderkey, {_ORDER} FROM orders)
SELECT o_orderkey, CAST(year AS INTEGER) AS first_year, 'PL ' || congress || '-' || law AS first_law, 'Order Act of ' || year AS short_title, CAST(year AS INTEGER) AS short_year, 'Pub. L. ' || congress || '–' || law AS short_law,
  1 AS "references", 'The Order Act, referred to in subsec. (a), is act no. ' || law || '.' AS reference, sec || '(a) text Inner words. Sig' AS unmarked, CASE WHEN sec % 2 = 0 THEN 36 ELSE 0 END AS wrapper FROM o""")
def note_forms(spark: SparkSession, d: str) -> DataFrame:
    """First amendments, short titles, references and marks of raw notes."""
    law = said("Pub. L. ", F.col("congress"), "–", F.col("law"))
    raw = said("[NH]Short Title of 1990 Amendment[/NH]", law, ' provided that it may be cited as the "Order Act of ', F.col("year"), '".[NH]References in Text[/NH]The Order Act, referred to in subsec. (a), is act no. ', F.col("law"), ". Too short.[NH]Amendments[/NH]none")
    found = notes.note_blocks(raw)
    short, refs = F.get(citations.short_titles(found), F.lit(0)), citations.references_in_text(found)
    first = citations.first_amendment(said(F.col("year"), "—", law, " did it."))
    marked = said("[NH]Editorial Notes[/NH]", F.col("sec"), "(a) text [H2]Inner[/H2] words. [SIG]Sig[/SIG][/H1]\n")
    wrapped = said(F.when(F.col("sec") % 2 == 0, "[NH]Historical[/NH] [H1]Notes[/H1]").otherwise("See the"), " Editorial Notes and so on")
    return _orders(spark, d).select(
        "o_orderkey", first["year"].alias("first_year"), first["law"].alias("first_law"), short["title"].alias("short_title"), short["year"].alias("short_year"), short["public_law"].alias("short_law"),
        F.size(refs).alias("references"), F.get(refs, F.lit(0)).alias("reference"), citations.without_marks(marked).alias("unmarked"), citations.wrapper_position(wrapped, "Editorial Notes").alias("wrapper"),
    )


@query("""SELECT o_orderkey, 'PLAW-' || (o_custkey % 20 + 95) || CASE WHEN o_orderkey % 2 = 0 THEN 'pvt' ELSE 'publ' END || o_orderkey AS package,
  CASE o_orderkey % 5 WHEN 0 THEN 'PL ' || o_custkey || '-' || o_orderkey WHEN 1 THEN 'Act of 1935-08-14 ch. ' || o_orderkey WHEN 2 THEN o_custkey || ' USC ' || o_orderkey WHEN 3 THEN '134 Stat. ' || o_orderkey ELSE '/us/x' END AS target,
  'CR 2/12/2013 H' || o_orderkey || '-9,CR S' || o_custkey AS pages, o_orderkey || ',' || o_custkey || 'a,7' AS listed, o_orderkey || ',' || (o_orderkey + 1) || ',' || (o_orderkey + 2) AS span,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Length differs: DB=' || length('x' || o_orderkey) || ', RP=' || length('x' || o_orderkey || 'y') || ' (delta=1)' ELSE 'First diff at char ' || (30 + length(CAST(o_orderkey AS VARCHAR))) || ': DB=''...' || right(repeat('s', 30) || o_orderkey, 20) || 'a' || repeat('t', 19) || '...'' vs RP=''...' || right(repeat('s', 30) || o_orderkey, 20) || 'b' || repeat('t', 19) || '...''' END AS difference
FROM orders""")
def reference_forms(spark: SparkSession, d: str) -> DataFrame:
    """Package ids, targets of references, pages of the Record, lists of sections and first differences."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("public_law", "act", "usc_section", "statute", "other"))), (k % 5).cast("int") + 1)
    ref = {"congress": c, "law_number": k, "act_date": F.lit("1935-08-14"), "act_chapter": k, "usc_title": c, "usc_section": k, "stat_volume": F.lit("134"), "stat_page": k}
    odd, even = said("s" * 30, k), said("x", k)
    old = F.when(k % 2 == 0, even).otherwise(said(odd, "a", "t" * 40))
    new = F.when(k % 2 == 0, said(even, "  y")).otherwise(said(odd, "b", "t" * 40))
    # The white space before y is one space more: left out of the shorter text's length.
    new = F.when(k % 2 == 0, said(even, "y")).otherwise(new)
    return table(spark, d, "orders").select(
        "o_orderkey", citations.package_id(c % 20 + 95, k, k % 2 == 0).alias("package"), citations.reference_target(kind, ref, F.lit("/us/x")).alias("target"),
        F.array_join(citations.record_references(said("Considered CR 2/12/2013 H", k, "-9 and CR S", c, ".")), ",").alias("pages"),
        F.array_join(citations.section_list(said("sections ", k, ", ", c, "a, and 7 of title 1")), ",").alias("listed"),
        F.array_join(citations.section_list(said("Sections ", k, " through ", k + 2)), ",").alias("span"), citations.described_difference(old, new).alias("difference"),
    )


# Headings and small forms

_SMALL = ", ".join(f"'{w}'" for w in headings.SMALL_WORDS)
_WORDS = "list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"
_CAP = "upper(substr(w, 1, 1)) || lower(substr(w, 2))"


@query(f"""WITH p AS (SELECT p_partkey, 'THE ' || upper(p_name) || ' OF A ' || upper(p_type) || ' AND' AS heading FROM part)
SELECT p_partkey, (SELECT string_agg(CASE WHEN i > 1 AND i < len(ws) AND lower(w) IN ({_SMALL}) THEN lower(w) ELSE {_CAP} END, ' ' ORDER BY i) FROM (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, ws)) AS titled,
  'Part II of the ' || lower(p_name) AS mixed, 'REPEALED ' || p_partkey AS plain, 'Part ' || p_partkey AS header, p_partkey || ' means it—all.' AS content
FROM (SELECT p_partkey, p_name, {_WORDS.format(t="replace(heading, '-', ' ')")} AS ws FROM p JOIN (SELECT p_partkey, p_name FROM part) USING (p_partkey))""")
def heading_forms(spark: SparkSession, d: str) -> DataFrame:
    """Headings in capitals, brackets and dashes."""
    p = table(spark, d, "part")
    name = F.regexp_replace(said("THE ", F.upper("p_name"), " OF A ", F.upper("p_type"), " AND"), "-", " ")
    split = headings.split_header(said("Part ", F.col("p_partkey"), "—", F.col("p_partkey"), " means it—all."))
    return p.select(
        "p_partkey", headings.title_cased(name).alias("titled"), headings.title_cased(said("Part II of the ", F.lower("p_name"))).alias("mixed"),
        headings.without_brackets(said(" [REPEALED ", F.col("p_partkey"), "] ")).alias("plain"), split["header"].alias("header"), split["content"].alias("content"),
    )


@query("""SELECT s_suppkey, 'Part Iv' || 'x' AS odd, 'Part IV ' || s_suppkey AS roman, 'Title of Congress' AS stopped, 'agriculture ' || s_suppkey AS committee, CASE WHEN s_suppkey % 3 = 0 THEN 'hsag00' WHEN s_suppkey % 3 = 1 THEN 'hlig00' END AS code,
  'One Act|Two Act ' || s_suppkey AS aliases, CASE WHEN s_suppkey % 2 = 0 THEN 'Unknown' ELSE 'President Bush' END AS president, chr(9) || chr(9) || s_suppkey AS tabbed, '    ' || s_suppkey AS spaced, '0,1,1,3' AS relative, 'a,2' AS markers
FROM supplier""")
def committee_and_heading_forms(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned headings, committee names and codes, aliases, presidents and indents."""
    k = F.col("s_suppkey")
    codes = {"agriculture": "hsag00", "permanent select committee on intelligence": "hlig00"}
    raw = F.when(k % 3 == 0, "Committee on the Agriculture.").when(k % 3 == 1, "Permanent Select Committee on Intelligence").otherwise("Select Committee on Nothing")
    levels = F.array(*map(F.lit, (0, 2, 2, 4)))
    return table(spark, d, "supplier").select(
        "s_suppkey", headings.cleaned_heading(said("PART IVX")).alias("odd"), headings.cleaned_heading(said("PART IV ", k, " .—")).alias("roman"), headings.cleaned_heading(said("Title of Con­gress .—")).alias("stopped"),
        headings.committee_name(said("Committee on the Agriculture ", k, ".")).alias("committee"), headings.committee_code(raw, codes).alias("code"),
        F.array_join(headings.aliases(said("One Act or the Two Act ", k)), "|").alias("aliases"), headings.president_title(F.when(k % 2 == 0, "Unknown").otherwise("George H.W. Bush")).alias("president"),
        headings.indented(k.cast("string"), F.lit(2)).alias("tabbed"), headings.indented(k.cast("string"), F.lit(1), 4).alias("spaced"),
        F.array_join(F.transform(headings.relative_indents(levels), lambda x: x.cast("string")), ",").alias("relative"), F.array_join(headings.list_markers(said("(a) see section (b) and paragraph (1) then (2) x", k)), ",").alias("markers"),
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN DATE '1970-01-01' ELSE DATE '2001-05-06' END AS vote_day, make_date(1900 + CAST(c_custkey % 200 AS INTEGER), 12, 31) AS year_day,
  CASE CAST(c_custkey % 4 AS INTEGER) WHEN 1 THEN DATE '1947-07-30' WHEN 3 THEN DATE '1948-06-25' END AS positive_day, DATE '1976-10-19' AS prose_day, 1900 + CAST(c_custkey % 100 AS INTEGER) AS first_year, 'Aug. 14, 1935' AS shown,
  '4–' || c_custkey AS dashed, '4-' || c_custkey AS plain, 'Removal Description ' || c_custkey AS spaced, 'removal-of-' || c_custkey AS slug, c_custkey % 2 = 0 AS roman, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 2 END AS level,
  CAST(119 AS INTEGER) AS rp_congress, CAST(c_custkey AS INTEGER) AS rp_law, '60' AS rp_not, 1 AS rp_update, 'Republican' AS party, 'House' AS chamber, CAST(17 AS INTEGER) AS cited_title, c_custkey || 'a' AS cited_section, '26/' || c_custkey || '/(c)(1)' AS usc, 'John Q. Public ' || c_custkey AS name,
  '115-' || c_custkey AS laws, 'amended,striking' AS words, 'x  new ' || c_custkey AS replaced
FROM customer""")
def scalar_forms(spark: SparkSession, d: str) -> DataFrame:
    """Dates, dashes, slugs, markers, release points, parties, citations, names and edits of small texts."""
    k = F.col("c_custkey")
    rp, cited, usc = release_point(said("119-", k, "not60u1")), citation(said("17 U.S.C. § ", k, "a")), usc_reference(said("/us/usc/t26/s", k, "/c/1"))
    marker = F.when(k % 2 == 0, "ii").otherwise("2")
    return table(spark, d, "customer").select(
        "c_custkey", headings.vote_date(F.when(k % 2 == 0, "soon").otherwise("2001-05-06T10:00:00Z")).alias("vote_day"), headings.year_date((k % 200 + 1900).cast("int"), 12, 31).alias("year_day"),
        headings.positive_law_date(F.when(k % 4 == 0, 99).when(k % 4 == 1, 1).when(k % 4 == 3, 3).otherwise(2)).alias("positive_day"), prose_date(F.lit("Oct. 19, 1976")).alias("prose_day"),
        first_year(said("of ", k % 100 + 1900, ", ch. 3")).alias("first_year"), display_date(F.lit("1935-08-14").cast("date")).alias("shown"), en_dashed(said("4-", k)).alias("dashed"), plain_dashed(said("4 – ", k)).alias("plain"),
        spaced_title(said("removalDescription ", k)).alias("spaced"), slug(said("Removal of: ", k)).alias("slug"), (is_roman(marker) & marker.rlike("[a-z]")).alias("roman"), indent_level(marker).alias("level"),
        rp["congress"].alias("rp_congress"), rp["law_number"].alias("rp_law"), F.array_join(F.transform(rp["not_laws"], lambda x: x.cast("string")), ",").alias("rp_not"), rp["update_number"].alias("rp_update"),
        party(F.lit("the Republican Party")).alias("party"), chamber_of(F.lit("House of Representatives")).alias("chamber"), cited["title_number"].alias("cited_title"), cited["section_number"].alias("cited_section"),
        F.concat_ws("/", usc["title_number"].cast("string"), usc["section_number"], usc["subsection_path"]).alias("usc"), full_name(F.lit("JOHN"), F.lit("Q."), F.lit("PUBLIC"), k.cast("string")).alias("name"),
        F.array_join(public_laws(said("see Pub. L. 115-", k, " and Public Law 115-", k)), ",").alias("laws"), F.array_join(edit_words(F.lit("is amended by striking")), ",").alias("words"),
        first_replaced(said("x  OLD  words ", k), F.lit("old words"), F.lit("new"))["text"].alias("replaced"),
    )


@query("SELECT p_partkey, uuid_of.u AS uuid, CASE WHEN length(p_name) > 50 THEN substr(p_name, 1, 47) || '...' ELSE p_name END AS short FROM part, LATERAL (SELECT h, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u FROM (SELECT sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('title:' || p_partkey)) AS h)) uuid_of")
def group_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids of groups from their path keys."""
    return table(spark, d, "part").select("p_partkey", headings.name_uuid(said("title:", F.col("p_partkey")), "6ba7b810-9dad-11d1-80b4-00c04fd430c8").alias("uuid"), shortened(F.col("p_name")).alias("short"))


# Bills' histories

_ACTIONS = """a AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'IntroReferral' WHEN 'click' THEN 'IntroReferral' WHEN 'purchase' THEN 'Floor' WHEN 'error' THEN 'President' ELSE 'Calendars' END AS action_type,
  CASE event_type WHEN 'view' THEN 'Introduced in House' WHEN 'click' THEN 'Referred to the Committee' WHEN 'purchase' THEN 'Passed by recorded vote: ' || event_id || ' - 17 - 26.' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'Vetoed by President.' ELSE 'Signed by President.' END ELSE 'Placed' END AS text,
  CASE WHEN event_id % 2 = 0 THEN 'House' ELSE 'Senate' END AS chamber FROM events),
c AS (SELECT *, CASE action_type WHEN 'IntroReferral' THEN CASE WHEN text LIKE 'Intro%' THEN 'introduced' ELSE 'committee_referral' END WHEN 'Floor' THEN lower(chamber) || '_vote' WHEN 'President' THEN 'presidential_action' ELSE 'other' END AS event_type FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sort_order, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM c),
k AS (SELECT event_id, user_id, event_type, CAST(sort_order AS INTEGER) AS sort_order, event_type LIKE '%_vote' OR event_type = 'presidential_action' OR (event_type IN ('introduced', 'committee_referral') AND nth = 1) AS is_milestone,
  CASE WHEN event_type LIKE '%_vote' THEN CAST(event_id AS INTEGER) END AS vote_yeas, CASE WHEN event_type LIKE '%_vote' THEN 17 END AS vote_nays, CASE WHEN event_type LIKE '%_vote' THEN 26 END AS vote_not_voting,
  CASE event_type WHEN 'introduced' THEN 'Bill introduced in the ' || chamber WHEN 'committee_referral' THEN 'Referred to committee' WHEN 'house_vote' THEN 'Passed the House' WHEN 'senate_vote' THEN 'Passed the Senate' WHEN 'other' THEN text ELSE CASE WHEN text LIKE 'Veto%' THEN 'Vetoed by the President' ELSE 'Signed into law' END END AS event_title FROM n)"""


def _actions(spark: SparkSession, d: str) -> DataFrame:
    of = lambda **x: F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in x.items() if k != "other"), F.lit(x["other"]))
    signed = F.when(F.col("event_id") % 3 == 0, "Vetoed by President.").otherwise("Signed by President.")
    kinds = of(view="IntroReferral", click="IntroReferral", purchase="Floor", error="President", other="Calendars")
    text = of(view="Introduced in House", click="Referred to the Committee", purchase=said("Passed by recorded vote: ", F.col("event_id"), " - 17 - 26."), error=signed, other="Placed")
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", kinds.alias("action_type"), text.alias("text"), F.when(F.col("event_id") % 2 == 0, "House").otherwise("Senate").alias("chamber"))
    return history.classified_actions(rows, ["user_id"], ["ts", "event_id"])


@query(f"WITH {_ACTIONS} SELECT * FROM k")
def bill_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions of bills, classified, with milestones, votes and titles."""
    return _actions(spark, d).select("event_id", "user_id", "event_type", "sort_order", "is_milestone", "vote_yeas", "vote_nays", "vote_not_voting", "event_title")


@query(f"""WITH {_ACTIONS} SELECT user_id, CASE max_by(event_title, sort_order) FILTER (event_type = 'presidential_action') WHEN 'Signed into law' THEN 'enacted' WHEN 'Vetoed by the President' THEN 'vetoed' ELSE 'pending' END AS status, count(*) FILTER (is_milestone) AS milestones,
  max_by(vote_yeas, sort_order) FILTER (event_type = 'house_vote') AS house_yeas, max_by(vote_nays, sort_order) FILTER (event_type = 'house_vote') AS house_nays, max_by(vote_yeas, sort_order) FILTER (event_type = 'senate_vote') AS senate_yeas, max_by(vote_nays, sort_order) FILTER (event_type = 'senate_vote') AS senate_nays FROM k GROUP BY 1""")
def law_status(spark: SparkSession, d: str) -> DataFrame:
    """What became of each bill, with the last vote of each chamber."""
    return history.law_status(_actions(spark, d), ["user_id"])


@query("SELECT c_custkey, c_nationkey, 'ANN ' || c_name AS name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 10 = 0 DESC, c_custkey) - 1 AS INTEGER) AS sort_order FROM customer")
def ordered_sponsors(spark: SparkSession, d: str) -> DataFrame:
    """Sponsors, the primary one first."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 10 == 0).alias("is_primary"), F.col("c_custkey").alias("position"), F.lit("ANN").alias("first_name"), F.lit(None).cast("string").alias("middle_name"), F.col("c_name").alias("last_name"), F.lit("x").alias("full_name"))
    return history.ordered_sponsors(rows, ["c_nationkey"]).select("c_custkey", "c_nationkey", "name", "sort_order")


@query("SELECT c_custkey, coalesce(max_by(o_orderkey, o_orderkey) - 1, (SELECT max(o_orderkey) FROM orders)) AS parent_revision_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def parent_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The parent revision of each law, else the head."""
    revisions = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("revision_id"), (F.col("o_orderkey") - 1).alias("parent_revision_id"), F.col("o_orderkey").alias("sequence_number"))
    return history.parent_revisions(table(spark, d, "customer").select("c_custkey"), revisions, ["c_custkey"])


@query("SELECT o_orderkey, n_name AS law_number FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0")
def related_laws(spark: SparkSession, d: str) -> DataFrame:
    """Related bills with the laws that they became."""
    related = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("related_bill_id"))
    bills = table(spark, d, "customer").select(F.col("c_custkey").alias("bill_id"), F.col("c_nationkey").alias("law_id"))
    laws = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("law_id"), F.col("n_name").alias("law_number"))
    return history.related_laws(related, bills, laws).select("o_orderkey", "law_number")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    year = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, year).alias("start_year"), F.when(F.col("o_orderkey") % 3 > 0, year + (F.col("o_orderkey") % 3).cast("int")).alias("end_year"), F.when(F.col("o_orderkey") % 2 == 0, "OH").alias("state"))


_TERMS = "t AS (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS start_year, CASE WHEN o_orderkey % 3 > 0 THEN CAST(year(o_orderdate) + o_orderkey % 3 AS INTEGER) END AS end_year, CASE WHEN o_orderkey % 2 = 0 THEN 'OH' ELSE 'XX' END AS state FROM orders WHERE o_orderkey % 11 > 0)"


@query(f"WITH {_TERMS} SELECT o_custkey, make_date(min(start_year), 1, 1) AS first_served, make_date(max(end_year), 12, 31) AS last_served FROM t GROUP BY 1")
def served_spans(spark: SparkSession, d: str) -> DataFrame:
    """First and last day served."""
    return history.served_span(history.normalized_terms(_terms(spark, d)), ["o_custkey"])


@query(f"WITH {_TERMS} SELECT o_orderkey, state, make_date(start_year, 1, 1) AS start_date, make_date(end_year, 12, 31) AS end_date FROM t")
def normalized_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of office with defaults."""
    return history.normalized_terms(_terms(spark, d)).select("o_orderkey", "state", "start_date", "end_date")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def laws_to_seed(spark: SparkSession, d: str) -> DataFrame:
    """Laws without a history yet."""
    return history.to_seed(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE max_by('Line ' || o_orderkey || chr(10) || chr(10) || 'End', o_orderkey) END AS signing_statement FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def signing_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements out of their pages, attached to laws that have none."""
    page = said("<html><PRE class='x'>[Page 3]\nLine <b>", F.col("o_orderkey"), "</b>  \n\n\n\nEnd\n[Note]\n</PRE>")
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("issued_date"), history.statement_text(page).alias("statement"))
    laws = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "own").alias("signing_statement"))
    return history.with_statements(laws, found, ["c_custkey"])


@query("""SELECT o_orderkey, coalesce(s, 0) AS sections, coalesce(n, 0) AS changes, round(ln(1 + coalesce(s, 0)), 6) AS focus, round(coalesce(CAST(n AS DOUBLE) / s, 0), 6) AS depth, 30 AS days_to_passage, o_custkey - 17 AS margin
FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT (l_partkey % 5, l_suppkey)) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def focus_scores(spark: SparkSession, d: str) -> DataFrame:
    """How wide and deep each law reaches, how long it took and how it was voted."""
    laws = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("introduced_date"), F.date_add(F.to_date("o_orderdate"), 30).alias("enacted_date"), F.col("o_custkey").alias("yeas"), F.lit(17).alias("nays"))
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 5).alias("title_number"), F.col("l_suppkey").alias("section_number"))
    out = history.focus_score(laws, changes, ["o_orderkey"])
    return out.select("o_orderkey", "sections", "changes", F.round("focus", 6).alias("focus"), F.round("depth", 6).alias("depth"), "days_to_passage", "margin")


# Play-forward

_PLACE = "coalesce(event_date, DATE '0001-01-01'), CASE WHEN event_type = 'public_law' THEN 0 ELSE 1 END, congress, coalesce(law_number, 0), identifier"
_NUMBERED = f"WITH {_ALL_EVENTS}, p AS (SELECT *, row_number() OVER (ORDER BY {_PLACE}) AS position FROM e)"
_OUTCOMES = """u AS (SELECT identifier, CASE WHEN (congress, law_number) IN (SELECT 100 + CAST(c_custkey % 5 AS INTEGER), CAST(c_custkey % 1000 AS INTEGER) FROM customer WHERE c_acctbal < 0) THEN 'deferred'
  WHEN CAST(substr(identifier, 2) AS BIGINT) % 3 = 0 THEN 'missing' WHEN coalesce(n, 0) = 0 THEN 'failed' ELSE 'applied' END AS outcome, coalesce(n, 0) AS changes
  FROM e LEFT JOIN (SELECT 'L' || l_orderkey AS identifier, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (identifier) WHERE event_type = 'public_law')"""


@query(f"{_NUMBERED} SELECT identifier, event_type FROM p WHERE position > (SELECT position FROM p WHERE identifier = 'R10') AND position <= (SELECT position FROM p WHERE identifier = 'R10') + 50")
def next_events(spark: SparkSession, d: str) -> DataFrame:
    """The fifty events after the head's: the limit is what is asked for."""
    return chrono.next_events(_all_events(spark, d), "R10", 50).select("identifier", "event_type")


@query(f"{_NUMBERED} SELECT identifier, event_type FROM p WHERE position > (SELECT position FROM p WHERE identifier = 'R10') AND position <= (SELECT position FROM p WHERE identifier = 'R60')")
def events_until(spark: SparkSession, d: str) -> DataFrame:
    """What advancing from one release point to another plays."""
    return chrono.events_until(_all_events(spark, d), "R10", "R60").select("identifier", "event_type")


def _outcomes(spark: SparkSession, d: str, events: DataFrame) -> DataFrame:
    deferred = table(spark, d, "customer").where("c_acctbal < 0").select((F.col("c_custkey") % 5 + 100).cast("int").alias("congress"), (F.col("c_custkey") % 1000).cast("int").alias("law_number"))
    texts = table(spark, d, "orders").where("o_orderkey % 3 > 0").select(said("L", F.col("o_orderkey")).alias("identifier"))
    changes = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(said("L", F.col("l_orderkey")).alias("identifier"))
    return chrono.law_outcomes(events, deferred, texts, changes)


@query(f"WITH {_ALL_EVENTS}, {_OUTCOMES} SELECT * FROM u")
def law_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Deferred, missing, failed and applied laws of the whole timeline."""
    return _outcomes(spark, d, _all_events(spark, d))


@query(f"WITH {_ALL_EVENTS}, {_OUTCOMES}, w AS (SELECT e.*, row_number() OVER (ORDER BY {_PLACE}) AS n FROM e WHERE event_type = 'release_point' OR identifier IN (SELECT identifier FROM u WHERE outcome = 'applied')) SELECT 7 + n AS revision_id, 6 + n AS parent_revision_id, 3 + n AS sequence_number, identifier, event_type = 'release_point' AS is_ground_truth FROM w")
def new_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The revisions that playing the whole timeline makes, each with its parent."""
    events = _all_events(spark, d)
    return chrono.new_revisions(events, _outcomes(spark, d, events), 7, 3).select("revision_id", "parent_revision_id", "sequence_number", "identifier", "is_ground_truth")


_AFTER = """s AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN sha256(CASE WHEN coalesce(text, '') = '' THEN 'new' ELSE text || chr(10) || 'new' END) ELSE sha256(text) END AS text_hash FROM documents),
t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256('other') ELSE text_hash END AS text_hash FROM s WHERE doc_id % 5 > 0 OR doc_id % 25 = 0)"""


def _advanced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("title_number"), F.lit("1").alias("section_number"), F.col("text").alias("text_content"), F.sha2("text", 256).alias("text_hash"), F.lit(None).cast("string").alias("notes_hash"), F.lit(False).alias("is_deleted"))
    null = F.lit(None).cast("string")
    key = ["title_number", "section_number"]
    adds = docs.where("title_number % 3 = 0").select(*key, F.lit(1).alias("law_id"), F.lit(1).alias("change_id"), F.lit("Add").alias("change_type"), null.alias("old_text"), F.lit("new").alias("new_text"))
    gone = docs.where("title_number % 5 = 0").select(*key, F.lit(2).alias("law_id"), F.lit(1).alias("change_id"), F.lit("Repeal").alias("change_type"), null.alias("old_text"), null.alias("new_text"))
    laws = docs.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("law_id")).distinct().select("law_id", F.lit(None).cast("date").alias("enacted_date"), F.lit(1).alias("congress"), F.col("law_id").cast("string").alias("law_number"))
    text = F.when(F.col("title_number") % 3 == 0, F.when(F.coalesce("text_content", F.lit("")) == "", "new").otherwise(said(F.col("text_content"), "\nnew"))).otherwise(F.col("text_content"))
    expected = F.when(F.col("title_number") % 7 == 0, F.sha2(F.lit("other"), 256)).when(F.col("title_number") % 5 > 0, F.sha2(text, 256))
    truth = docs.where("title_number % 5 > 0 or title_number % 25 = 0").select(*key, expected.alias("text_hash"), "notes_hash", "is_deleted")
    return chrono.advanced(docs, adds.unionByName(gone), laws, truth, key)


@query(f"WITH {_AFTER} SELECT doc_id AS title_number, text_hash FROM s WHERE doc_id % 5 > 0")
def advanced_states(spark: SparkSession, d: str) -> DataFrame:
    """All sections after two laws, the second of which repeals a fifth."""
    return _advanced(spark, d)[0].select("title_number", "text_hash")


@query(f"WITH {_AFTER} SELECT coalesce(a.doc_id, t.doc_id) AS title_number, CASE WHEN t.doc_id IS NULL THEN 'only_derived' WHEN a.doc_id IS NULL THEN 'only_truth' WHEN a.text_hash IS DISTINCT FROM t.text_hash THEN 'text_mismatch' ELSE 'match' END AS outcome FROM (SELECT * FROM s WHERE doc_id % 5 > 0) a FULL OUTER JOIN t ON a.doc_id = t.doc_id")
def advanced_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """The comparison with the release point at which the advance ends."""
    return _advanced(spark, d)[1].select("title_number", "outcome")


# Committees

_RULES = "WITH n AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)"


@query(f"""{_RULES} SELECT CAST(n_regionkey AS INTEGER) AS congress, chr(CAST(96 + i AS INTEGER)) AS clause_letter, 'Committee on ' || n_name AS committee_name, CASE WHEN n_nationkey % 2 = 0 THEN 'hs' || n_nationkey END AS committee_code, 'House Rule X, Clause 1(' || chr(CAST(96 + i AS INTEGER)) || ')' AS rule_citation,
  CASE WHEN n_nationkey % 3 > 0 THEN '(1) Matters of ' || n_name || ' & more.' || chr(10) || '(2) Item ' || n_nationkey || '.' ELSE '' END AS jurisdiction_text, CASE WHEN n_nationkey % 3 > 0 THEN 2 ELSE 0 END AS items FROM n""")
def committee_jurisdictions(spark: SparkSession, d: str) -> DataFrame:
    """Committees and their jurisdictions out of pages of rules, one of each region."""
    n = table(spark, d, "nation")
    codes = {r["n_name"].lower(): f"hs{r['n_nationkey']}" for r in n.where("n_nationkey % 2 = 0").select("n_name", "n_nationkey").collect()}
    letter = lambda i: F.chr(F.lit(97) + i)
    clause = lambda x, i: said("<p>(", letter(i), ") Committee on ", x["n_name"], ".</p>\n", F.when(x["n_nationkey"] % 3 > 0, said("<p>(1) Matters\n of <i>", x["n_name"], "</i> &amp; more.</p><div>(2) Item ", x["n_nationkey"], ".</div>")).otherwise(""))
    own = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), clause)
    pages = n.groupBy(F.col("n_regionkey").cast("int").alias("congress")).agg(said("<html><h2>RULE IX</h2><p>(a) Committee on Other.</p><h2>Rule X.</h2>", F.array_join(own, ""), "<h2>RULE XI</h2><p>(a) Committee on None.</p>").alias("html"))
    return committees.jurisdictions(pages, codes)


def _mappings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    start = (k % 20 + 90).cast("int")
    rows = table(spark, d, "part").select(k.alias("mapping_id"), F.col("p_size").alias("title_number"), F.when(k % 3 > 0, F.col("p_brand")).alias("chapter"), (k % 25).cast("int").alias("committee_id"), start.alias("start_congress"), F.when(k % 2 == 0, start + 5).alias("end_congress"))
    return rows, table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("committee_id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") < 3, "House").otherwise("Senate").alias("chamber"))


_MAPPINGS = "m AS (SELECT p_partkey AS mapping_id, p_size AS title_number, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS chapter, CAST(p_partkey % 25 AS INTEGER) AS committee_id FROM part WHERE p_partkey % 20 + 90 <= 100 AND (p_partkey % 2 > 0 OR p_partkey % 20 + 95 >= 100))"


@query(f"WITH {_MAPPINGS} SELECT mapping_id, title_number, n_name AS name FROM m JOIN nation ON n_nationkey = committee_id WHERE chapter IS NULL")
def owners_of_titles(spark: SparkSession, d: str) -> DataFrame:
    """Owners of whole titles in the 100th Congress."""
    return committees.owners_of_titles(*_mappings(spark, d), 100).select("mapping_id", "title_number", "name")


@query(f"WITH {_MAPPINGS} SELECT mapping_id, title_number, chapter, n_name AS name FROM m JOIN nation ON n_nationkey = committee_id")
def all_owners(spark: SparkSession, d: str) -> DataFrame:
    """All owners in the 100th Congress."""
    return committees.all_owners(*_mappings(spark, d), 100).select("mapping_id", "title_number", "chapter", "name")


@query(f"WITH {_MAPPINGS} SELECT c.title_number, c.chapter, coalesce((SELECT min(committee_id) FROM m WHERE m.title_number = c.title_number AND m.chapter = c.chapter), (SELECT min(committee_id) FROM m WHERE m.title_number = c.title_number AND m.chapter IS NULL)) AS committee_id FROM (SELECT DISTINCT p_size AS title_number, p_brand AS chapter FROM part) c")
def owners_of_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A chapter's owner, else its title's."""
    chapters = table(spark, d, "part").select(F.col("p_size").alias("title_number"), F.col("p_brand").alias("chapter")).distinct()
    return committees.owners_of_chapters(chapters, _mappings(spark, d)[0], 100)


@query(f"WITH {_MAPPINGS} SELECT p_partkey AS mapping_id, n_name AS name FROM part JOIN nation ON n_nationkey = p_partkey % 25 WHERE p_partkey % 20 + 90 = 100 AND n_regionkey < 3")
def committee_instances(spark: SparkSession, d: str) -> DataFrame:
    """A Congress's committees of one chamber."""
    rows, names = _mappings(spark, d)
    return committees.instances(rows.withColumnRenamed("start_congress", "congress"), names, 100, "House").select("mapping_id", "name")


# Look-ups and views


def _discoveries(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("New", "Under_Review", "Promoted", "Rejected"))), (F.col("doc_id") % 4).cast("int") + 1)
    return table(spark, d, "documents").select(F.col("doc_id").alias("discovery_id"), status.alias("status"), "text", F.col("doc_id").alias("created_at"), (-F.col("doc_id")).alias("reviewed_at"))


@query("SELECT doc_id AS discovery_id FROM documents WHERE doc_id % 4 IN (0, 1) ORDER BY doc_id DESC LIMIT 50")
def pending_discoveries(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty discoveries to be reviewed: the limit is the page."""
    return catalog.pending_discoveries(_discoveries(spark, d), 50).select("discovery_id")


@query("SELECT doc_id AS discovery_id FROM documents WHERE doc_id % 4 = 2")
def promoted_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Discoveries that became patterns."""
    return catalog.promoted_patterns(_discoveries(spark, d)).select("discovery_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY AND user_id = 7")
def escalated_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A law's sessions that were escalated within the last days."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("session_id"), F.col("user_id").alias("law_id"), (F.col("event_type") == "error").alias("escalated"), F.col("ts").cast("timestamp_ntz").alias("started_at"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return catalog.escalated_sessions(rows, now, 10, 7).select(F.col("session_id").alias("event_id"))


@query("SELECT o_custkey, DISTINCT_titles AS title_number FROM (SELECT o_custkey, unnest(list_distinct([CAST(o_orderkey % 50 AS INTEGER), CAST(o_orderkey % 7 AS INTEGER)])) AS DISTINCT_titles FROM orders WHERE o_orderkey = 7)")
def titles_at_release_point(spark: SparkSession, d: str) -> DataFrame:
    """The titles that one release point holds."""
    k = F.col("o_orderkey")
    points = table(spark, d, "orders").select(k.cast("string").alias("identifier"), F.array((k % 50).cast("int"), (k % 7).cast("int")).alias("titles"), "o_custkey")
    owner = catalog.one(points, identifier="7").select("o_custkey")
    return catalog.titles_at(points, "7").crossJoin(F.broadcast(owner.limit(1)))


@query("SELECT l_orderkey AS title_number, l_linenumber AS section_number FROM lineitem WHERE l_partkey % 10 = 3 AND l_suppkey % 10 = 4")
def sections_amended_by(spark: SparkSession, d: str) -> DataFrame:
    """Sections whose notes list an amendment by one law."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("title_number"), F.col("l_linenumber").alias("section_number"), F.array(F.struct((F.col("l_partkey") % 10).alias("congress"), (F.col("l_suppkey") % 10).alias("law_number"))).alias("amendments"))
    return catalog.amended_by(rows, 3, 4).select("title_number", "section_number")


@query("SELECT p_partkey AS section_number, p_name AS heading FROM part WHERE (lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%econ%') AND p_size IN (3, 5, 11) AND DATE '1995-01-01' + CAST(p_partkey % 1000 AS INTEGER) BETWEEN DATE '1995-03-01' AND DATE '1996-12-31' ORDER BY DATE '1995-01-01' + CAST(p_partkey % 1000 AS INTEGER) DESC, p_size, p_partkey LIMIT 20")
def advanced_search(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty hits in some titles, modified within two years: the limit is the page."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.col("p_size").alias("title_number"), k.alias("section_number"), k.alias("sort_order"), F.col("p_name").alias("heading"), F.col("p_type").alias("text"), F.date_add(F.lit("1995-01-01").cast("date"), (k % 1000).cast("int")).alias("last_modified"))
    hits = rows.where(relations.contains(F.col("heading"), "red") | relations.contains(F.col("text"), "econ")).withColumns({"text": F.lit("hit")})
    return catalog.search(hits, "hit", [3, 5, 11], ("1995-03-01", "1996-12-31"), "newest")[0].select("section_number", "heading")


@query("SELECT c_custkey, n AS compared, m AS matched, round(CASE WHEN n > 0 THEN CAST(m AS DOUBLE) / n ELSE 0 END, 6) AS match_rate, coalesce(CAST(m AS DOUBLE) / nullif(n, 0), 0) >= 0.95 AND c_custkey % 9 > 0 AS is_valid FROM (SELECT c_custkey, count(o_orderkey) AS n, count(o_orderkey) FILTER (o_orderstatus <> 'P') AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def valid_reports(spark: SparkSession, d: str) -> DataFrame:
    """Which validations pass."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("o_orderstatus") != "P").alias("matched"))
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, 1).otherwise(0).alias("errors")).join(o, "c_custkey", "left").fillna(0, ["compared", "matched"])
    out = catalog.is_valid(rows)
    return out.select("c_custkey", "compared", "matched", F.round("match_rate", 6).alias("match_rate"), "is_valid")


@query("""SELECT 'r1' AS id, 0 AS depth, '' AS place, 'group' AS kind UNION ALL SELECT 'n' || n_nationkey, 1, CAST(n_nationkey AS VARCHAR), 'group' FROM nation WHERE n_regionkey = 1
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2, c_nationkey || '/' || (c_custkey + 1099511627776), 'section' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1""")
def title_tree(spark: SparkSession, d: str) -> DataFrame:
    """A title's table of contents, groups and sections with their places."""
    r = table(spark, d, "region").select(said("r", F.col("r_regionkey")).alias("group_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("sort_order"), F.col("r_name").alias("heading"))
    n = table(spark, d, "nation").select(said("n", F.col("n_nationkey")).alias("group_id"), said("r", F.col("n_regionkey")).alias("parent_id"), F.col("n_nationkey").cast("long").alias("sort_order"), F.col("n_name").alias("heading"))
    c = table(spark, d, "customer").select(said("n", F.col("c_nationkey")).alias("group_id"), F.col("c_custkey").cast("string").alias("section_number"), F.col("c_custkey").alias("sort_order"), F.col("c_name").alias("heading"))
    out = viewer.title_tree(r.unionByName(n), c, "r1")
    return out.select("id", "depth", F.array_join(F.transform("place", lambda x: x.cast("string")), "/").alias("place"), "kind")


@query("""WITH b AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'n' END AS notes FROM documents WHERE doc_id % 11 > 0), a AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') || '!' ELSE text END AS text, CASE WHEN doc_id % 6 < 2 THEN 'm' WHEN doc_id % 3 = 0 THEN 'n' END AS notes FROM documents WHERE doc_id % 13 > 0),
x AS (SELECT coalesce(a.doc_id, b.doc_id) AS title_number, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change, a.text AS new, b.text AS old, a.notes AS n, b.notes AS m FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id)
SELECT title_number, change, 'body' AS card FROM x WHERE new IS DISTINCT FROM old UNION ALL SELECT title_number, change, 'added_note' FROM x WHERE m IS NULL AND n IS NOT NULL UNION ALL SELECT title_number, change, 'note' FROM x WHERE m IS NOT NULL AND n IS DISTINCT FROM m""")
def diff_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of what a law changes: bodies, notes and new notes."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    row = lambda text, notes: [k.alias("title_number"), F.lit("1").alias("section_number"), text.alias("text_content"), notes.alias("notes")]
    before = docs.where(k % 11 > 0).select(*row(F.col("text"), F.when(k % 3 == 0, "n")))
    after = docs.where(k % 13 > 0).select(*row(F.when(k % 4 == 0, said(F.coalesce("text", F.lit("")), "!")).otherwise(F.col("text")), F.when(k % 6 < 2, "m").when(k % 3 == 0, "n")))
    return viewer.diff_cards(before, after)[0].select("title_number", "change", "card")


@query("SELECT doc_id, substr('The Secretary shall report ' || doc_id || '. ' || coalesce(text, ''), 1, 300) || CASE WHEN length('The Secretary shall report ' || doc_id || '. ' || coalesce(text, '')) > 300 THEN '...' ELSE '' END AS excerpt FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 > 0")
def standalone_provisions(spark: SparkSession, d: str) -> DataFrame:
    """Provisions that amend no other law."""
    k = F.col("doc_id")
    text = F.when(k % 2 == 0, said("The Secretary shall report ", k, ". ", F.coalesce("text", F.lit("")))).otherwise(said("Section ", k, " is hereby amended to read as follows: ", F.coalesce("text", F.lit(""))))
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"), F.when(k % 5 == 0, True).alias("has_sidenote"))
    return viewer.standalone_provisions(rows).select("doc_id", "excerpt")


@query(f"""WITH {standins.SNAPSHOTS_SQL}, {standins.REVISIONS_SQL.replace('{head}', '30')}, s AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY title_number, section_number ORDER BY c.chain_pos, snapshot_id) AS rn FROM snapshots s JOIN chain c USING (revision_id)) WHERE rn = 1 AND NOT coalesce(is_deleted, false)),
r AS (SELECT title_number, section_number, count(*) AS changes, max(revision_id) AS changed_at, min(revision_id) AS first_revision FROM (SELECT s.*, lead(text_hash) OVER (PARTITION BY title_number, section_number ORDER BY chain_pos, snapshot_id) AS older FROM snapshots s JOIN chain USING (revision_id)) WHERE older IS NULL OR text_hash IS NULL OR older <> text_hash GROUP BY 1, 2)
SELECT title_number, section_number, n_name AS group_heading, coalesce(changes, 0) AS changes, changed_at, first_revision, notes_hash IS NOT NULL AS has_notes FROM s LEFT JOIN r USING (title_number, section_number) LEFT JOIN nation ON n_nationkey = title_number % 25""")
def section_views(spark: SparkSession, d: str) -> DataFrame:
    """Every live section with its group, its real changes and whether it has notes."""
    from ..operators import snapshots

    rows = standins.snapshots(spark, d)
    chain = snapshots.revision_chain(standins.revisions(spark, d), 30)
    states = snapshots.states_at(rows, chain).withColumn("group_id", (F.col("title_number") % 25).cast("int"))
    groups = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("group_id"), F.col("n_name").alias("heading"))
    return viewer.section_view(states, rows, chain, groups).select("title_number", "section_number", "group_heading", "changes", "changed_at", "first_revision", "has_notes")


# Notes and upkeep


def _raw_notes() -> Column:
    k = F.col("o_orderkey")
    return said(
        F.when(k % 10 == 0, "Transferred: reclassified as section 12a of Title 34. ").when(k % 10 == 1, "Omitted by the reviser. ").otherwise(""),
        "[NH]Derivation[/NH]From an act of ", k, ", of which little else is known.[H1]Editorial Notes[/H1][NH]Amendments[/NH]", F.col("year"), "—Pub. L. ", F.col("congress"), "–", F.col("law"), " struck out some of the words.",
        "[NH]Codification[/NH]short[H1]Statutory Notes and Related Subsidiaries[/H1][NH]Short Title[/NH]Pub. L. 9–", k, ' is the "Order Act of 1999" as it was then enacted.[NH]Savings[/NH]One word headings are no notes here, however long they are.',
        "[NH]Effective Date[/NH][PARA]It takes effect on [H2]the day[/H2] [QC:2]quoted words[/QC] that follows all others.",
    )


def _note_rows(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", _raw_notes().alias("raw_notes"))


@query(f"""WITH o AS (SELECT o_orderkey, {_ORDER} FROM orders)
SELECT o_orderkey, 0 AS position, 'historical' AS category, 'Derivation' AS header, 'From an act of ' || o_orderkey || ', of which little else is known.' AS content FROM o
UNION ALL SELECT o_orderkey, 1, 'editorial', 'Amendments', year || '—Pub. L. ' || congress || '–' || law || ' struck out some of the words.' FROM o
UNION ALL SELECT o_orderkey, 2, 'statutory', 'Short Title', 'Pub. L. 9–' || o_orderkey || ' is the "Order Act of 1999" as it was then enacted.' FROM o
UNION ALL SELECT o_orderkey, 3, 'statutory', 'Effective Date', 'It takes effect on the day quoted words that follows all others.' FROM o""")
def notes_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Notes under a section, by category, without noise."""
    return notes.by_category(notes.notes_document(_note_rows(spark, d), ["o_orderkey"]), ["o_orderkey"])


@query(f"""WITH o AS (SELECT o_orderkey, {_ORDER} FROM orders)
SELECT o_orderkey, 'editorial,historical,statutory' AS categories, CAST(year AS INTEGER) AS first_year, 'PL ' || congress || '-' || law AS first_law, 1 AS amended, 'Order Act of 1999' AS short_title, CASE WHEN o_orderkey % 10 = 0 THEN '34 U.S.C. § 12a' END AS transferred_to, o_orderkey % 10 = 1 AS omitted, true AS has_amendments FROM o""")
def notes_documents(spark: SparkSession, d: str) -> DataFrame:
    """What a section's notes say as a whole."""
    doc = notes.notes_document(_note_rows(spark, d), ["o_orderkey"])
    return doc.select("o_orderkey", F.array_join("categories", ",").alias("categories"), F.col("first_amendment.year").alias("first_year"), F.col("first_amendment.law").alias("first_law"), F.size("amendments").alias("amended"), F.get("short_titles", F.lit(0))["title"].alias("short_title"), "transferred_to", "omitted", "has_amendments")


@query("""SELECT o_orderkey, 0 AS position, 'text' AS kind, 0 AS indent, 'It takes effect on' AS text FROM orders UNION ALL SELECT o_orderkey, 1, 'header', 0, 'the day ' || o_orderkey FROM orders
UNION ALL SELECT o_orderkey, 2, 'quoted', 2, 'quoted words' FROM orders UNION ALL SELECT o_orderkey, 3, 'signature', 0, 'A. B.' FROM orders UNION ALL SELECT o_orderkey, 4, 'text', 0, 'and after.' FROM orders""")
def note_lines(spark: SparkSession, d: str) -> DataFrame:
    """Typed lines of notes."""
    raw = said("[PARA]It takes   effect on [H2]the day ", F.col("o_orderkey"), "[/H2] [QC:2]quoted words[/QC]\n[SIG]A. B.[/SIG][PARA]and after.")
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(notes.typed_lines(raw)).alias("position", "x")).select("o_orderkey", "position", "x.kind", "x.indent", "x.text")


@query("""SELECT o_orderkey, '(a) The text of ' || o_orderkey || '.' AS law, CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN 'Amendments' || chr(10) || '1990—x' WHEN 1 THEN '(Pub. L. 94–553, § 3.)' || chr(10) || 'Codification' END AS notes FROM orders""")
def text_and_notes(spark: SparkSession, d: str) -> DataFrame:
    """Section texts apart from their notes."""
    k = F.col("o_orderkey")
    text = said("(a) The text of ", k, ".", F.when(k % 3 == 0, "\n Amendments\n1990—x").when(k % 3 == 1, " (Pub. L. 94–553, § 3.)\nCodification").otherwise(""))
    out = notes.separated(text)
    return table(spark, d, "orders").select("o_orderkey", out["law"].alias("law"), out["notes"].alias("notes"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS c_name, ['x' || c_custkey % 5] AS tags FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 4")
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a recomputation changes, nested columns compared too."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    old = c.select("c_custkey", "c_name", F.array(F.when(k % 5 == 4, "old").otherwise(said("x", k % 5))).alias("tags"))
    new = c.select("c_custkey", F.when(k % 3 == 0, "changed").otherwise(F.col("c_name")).alias("c_name"), F.array(said("x", k % 5)).alias("tags"))
    return maintenance.changed_rows(old, new, ["c_custkey"])


@query("SELECT o_custkey, CAST(coalesce(max(o_orderdate) FILTER (o_orderkey % 4 > 0), max(o_orderdate)) AS DATE) AS last_modified FROM orders GROUP BY 1")
def last_modified_dates(spark: SparkSession, d: str) -> DataFrame:
    """The newest date of each section that isn't the original act's."""
    rows = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 4 == 0).alias("is_original"))
    return maintenance.last_modified(rows, ["o_custkey"])


@query("SELECT l_orderkey, count(*) FILTER (l_linenumber < 5 AND l_returnflag <> 'A') AS generated, count(*) FILTER (l_linenumber < 5 AND l_returnflag = 'A') AS skipped, count(*) FILTER (l_linenumber >= 5) AS unresolved, nullif(concat_ws(',', CASE WHEN count(*) FILTER (l_linenumber < 5 AND l_returnflag = 'N') > 0 THEN 'N:' || count(*) FILTER (l_linenumber < 5 AND l_returnflag = 'N') END, CASE WHEN count(*) FILTER (l_linenumber < 5 AND l_returnflag = 'R') > 0 THEN 'R:' || count(*) FILTER (l_linenumber < 5 AND l_returnflag = 'R') END), '') AS by_type FROM lineitem GROUP BY 1")
def diff_reports(spark: SparkSession, d: str) -> DataFrame:
    """What came of each law's edits."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("title_number"), F.when(F.col("l_linenumber") < 5, F.col("l_suppkey").cast("string")).alias("section_number"), (F.col("l_returnflag") == "A").alias("needs_review"), F.col("l_returnflag").alias("change_type"))
    out = maintenance.diff_report(rows, ["l_orderkey"])
    listed = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("l_orderkey", "generated", "skipped", "unresolved", listed.alias("by_type"))


@query("SELECT c_custkey, string_agg(o_orderkey || '=' || coalesce(n_name, '?'), ',' ORDER BY o_orderkey) AS cited FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = o_orderkey % 40 GROUP BY 1")
def enriched_citations(spark: SparkSession, d: str) -> DataFrame:
    """Lists of citations with the laws' titles."""
    k = F.col("o_orderkey")
    listed = F.sort_array(F.collect_list(F.struct(k.alias("law_number"), (k % 40).cast("int").alias("congress"))))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(listed.alias("citations"))
    named = table(spark, d, "orders").select((k % 40).cast("int").alias("congress"), k.alias("law_number")).join(table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("congress"), F.col("n_name").alias("title")), "congress")
    out = maintenance.enriched_citations(rows, ["c_custkey"], named)
    return out.select("c_custkey", F.array_join(F.transform("citations", lambda x: said(x["law_number"], "=", F.coalesce(x["title"], F.lit("?")))), ",").alias("cited"))


@query("""SELECT l_orderkey, l_linenumber, 'Modify ' || l_partkey || ' U.S.C. § ' || l_suppkey || CASE CAST(l_linenumber % 3 AS INTEGER) WHEN 0 THEN ': "a" → "' || substr(repeat('b', 60), 1, 47) || '..."' WHEN 1 THEN ': - "a"' ELSE '' END AS description, CAST(CASE WHEN l_linenumber % 2 = 0 THEN DATE '2000-01-01' ELSE o_orderdate END AS DATE) AS effective_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def stored_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes with their descriptions and the days from which they hold."""
    n = F.col("l_linenumber")
    text = maintenance.change_description(F.lit("Modify"), F.col("l_partkey"), F.col("l_suppkey").cast("string"), F.when(n % 3 < 2, "a"), F.when(n % 3 == 0, "b" * 60))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("description"), F.when(n % 2 == 0, F.lit("2000-01-01").cast("date")).alias("effective_date"))
    laws = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("enacted_date"))
    return maintenance.stored_changes(rows, laws, ["l_orderkey"])


@query("SELECT doc_id, CASE WHEN text LIKE '%a b%' THEN replace(text, 'a b', 'a—b') ELSE text END AS content FROM documents")
def replaced_notes(spark: SparkSession, d: str) -> DataFrame:
    """A pattern replaced inside notes."""
    rows = table(spark, d, "documents").select("doc_id", F.array(F.struct(F.lit("h").alias("header"), F.col("text").alias("content"))).alias("notes"))
    return rows.select("doc_id", F.get(maintenance.replaced_in(F.col("notes"), "a b", "a—b"), F.lit(0))["content"].alias("content"))


# Prose


@query("""SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN 'New text ' || o_orderkey || ' “inner” end.' WHEN 1 THEN 'all of it ' || o_orderkey WHEN 2 THEN 'later ' || o_orderkey ELSE 'a paragraph of ' || o_orderkey END AS text,
  CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN 'quoted' WHEN 1 THEN 'colon_to_section' WHEN 2 THEN 'quoted' ELSE 'paragraph' END AS method FROM orders""")
def following_texts(spark: SparkSession, d: str) -> DataFrame:
    """What instructions introduce, in each of the ways."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, said("x: “New text ", k, " “inner” end.” tail")).when(k % 4 == 1, said("x: all of it ", k, "\n(b) more")).when(k % 4 == 2, said("x and then \"later ", k, "\" y")).otherwise(said("x a paragraph of ", k, "\n\nmore"))
    got = table(spark, d, "orders").select("o_orderkey", prose.following_text(text, F.lit(1)).alias("f"))
    return got.select("o_orderkey", "f.text", "f.confidence", "f.method")


@query("""SELECT o_orderkey, 0 AS position, 0 AS paragraph, 'See Pub. L. 94–553, sec. 3(a) of No. ' || o_orderkey || '.' AS sentence, 0 AS start_char, length('See Pub. L. 94–553, sec. 3(a) of No. ' || o_orderkey || '.') AS end_char FROM orders
UNION ALL SELECT o_orderkey, 1, 0, 'It holds. (1) Not here.', length('See Pub. L. 94–553, sec. 3(a) of No. ' || o_orderkey || '.  '), length('See Pub. L. 94–553, sec. 3(a) of No. ' || o_orderkey || '.  It holds. (1) Not here.') FROM orders
UNION ALL SELECT o_orderkey, 2, 1, 'last one', length('See Pub. L. 94–553, sec. 3(a) of No. ' || o_orderkey || '.  It holds. (1) Not here.__'), length('See Pub. L. 94–553, sec. 3(a) of No. ' || o_orderkey || '.  It holds. (1) Not here.__last one') FROM orders""")
def law_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of laws with their offsets."""
    text = said("See Pub. L. 94–553, sec. 3(a) of No. ", F.col("o_orderkey"), ".  It holds. (1) Not here.\n\nlast one")
    out = prose.sentences(table(spark, d, "orders").select("o_orderkey", text.alias("text")), ["o_orderkey"], "text")
    return out.withColumn("start_char", F.col("start_char").cast("long")).withColumn("end_char", F.col("end_char").cast("long"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '0(a),1(c),2(' || o_orderkey || ')' END AS designated, CASE WHEN o_orderkey % 3 = 0 THEN 'a,b,' || o_orderkey END AS struck, o_orderkey % 7 < 3 OR o_orderkey % 5 > 2 AS escalate, CASE WHEN o_orderkey % 7 < 3 OR o_orderkey % 5 > 2 THEN 'LLM' END AS next_mode,
  nullif(concat_ws('; ', CASE WHEN o_orderkey % 7 < 3 THEN 'Coverage ' || (80 + o_orderkey % 7) || '.0% below threshold (85%)' END, CASE WHEN o_orderkey % 5 > 2 THEN (o_orderkey % 5 * 10) || '.0' || '' END), '') IS NOT NULL AS has_reason, CASE WHEN o_orderkey % 4 = 0 THEN 'no section' WHEN o_orderkey % 6 = 1 THEN 'no title' END AS error FROM orders""")
def instruction_forms(spark: SparkSession, d: str) -> DataFrame:
    """Designated sentences, struck subsections, escalations and resolved references."""
    k = F.col("o_orderkey")
    marks = prose.ordinal_markers(F.when(k % 2 == 0, said("by designating the first, second, and third sentences as subsections (a), (c), and (", k, ")")).otherwise(said("designating the first and second sentences as subsection (", k, ")")))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.array_join(F.transform(marks, lambda x: F.concat(x["sentence"].cast("string"), x["marker"])), ",").alias("designated"),
        F.array_join(prose.struck_subsections(F.when(k % 3 == 0, said("by striking subsections (a), (b) and (", k, ")")).otherwise("by striking (a)")), ",").alias("struck"),
        F.when(k % 7 < 3, k % 7 + 80).otherwise(90).cast("double").alias("coverage"), (k % 5).alias("needs_review"), F.lit(10).alias("edits"), F.lit(0).alias("flagged"), F.lit("RegEx").alias("mode"),
        F.when(k % 4 > 0, k.cast("string")).alias("section_number"), F.lit(None).cast("int").alias("title_number"),
    )
    out = prose.resolved(prose.escalation(rows), F.when(k % 6 != 1, 17))
    return out.select("o_orderkey", "designated", "struck", "escalate", "next_mode", F.col("reason").isNotNull().alias("has_reason"), "error")


@query("SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 END AS start_line FROM orders")
def start_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines at which edits begin, inside one line and across lines."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    content = F.array(said("Heading of ", k), said("The  OLD words of ", k, " stand"), said("and go on, ", k), F.lit("to the end"))
    lines = o.select("o_orderkey", F.posexplode(content).alias("p", "content")).select("o_orderkey", (F.col("p") + 1).alias("line_number"), "content")
    old = F.when(k % 4 == 0, "the old words").when(k % 4 == 1, said("GO  on, ", k)).when(k % 4 == 2, said("of ", k, " stand and go")).otherwise("nowhere at all")
    return prose.start_lines(o.select("o_orderkey", old.alias("old_text")), lines, ["o_orderkey"], "o_orderkey").select("o_orderkey", "start_line")


# Intake


@query("""WITH t AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey FROM orders)
SELECT c_custkey, 'Ann ' || upper(substr(c_name, 1, 1)) || lower(substr(c_name, 2)) AS full_name, CASE c_nationkey % 3 WHEN 0 THEN 'Republican' WHEN 1 THEN 'Democrat' ELSE 'Other' END AS party, CASE (max(o_orderkey) FILTER (y = top)) % 2 WHEN 0 THEN 'Senate' WHEN 1 THEN 'House' END AS current_chamber, min(y) AS first_year, max(y) AS last_year
FROM customer LEFT JOIN t ON o_custkey = c_custkey LEFT JOIN (SELECT o_custkey AS k, max(y) AS top FROM t GROUP BY 1) ON k = c_custkey GROUP BY c_custkey, c_name, c_nationkey""")
def member_rows(spark: SparkSession, d: str) -> DataFrame:
    """Members as stored, by their latest term."""
    terms = table(spark, d, "orders").select(F.col("o_custkey").alias("bioguide_id"), F.year("o_orderdate").alias("start_year"), F.year("o_orderdate").alias("end_year"), F.when(F.col("o_orderkey") % 2 == 0, "Senate").otherwise("House of Representatives").alias("chamber"), F.lit("OH").alias("state"), F.col("o_orderkey").alias("district"))
    # Of terms of one year the one with the larger order key is the latest.
    newest = terms.groupBy("bioguide_id", "start_year").agg(F.max_by(F.struct("end_year", "chamber", "state", "district"), "district").alias("s")).select("bioguide_id", "start_year", "s.*")
    details = table(spark, d, "customer").select(F.col("c_custkey").alias("bioguide_id"), F.lit("ANN").alias("first_name"), F.lit(None).cast("string").alias("middle_name"), F.upper("c_name").alias("last_name"), F.when(F.col("c_nationkey") % 3 == 0, "Republican Party").when(F.col("c_nationkey") % 3 == 1, "Democratic").otherwise("Green").alias("party"))
    return intake.member_rows(details, newest).select(F.col("bioguide_id").alias("c_custkey"), "full_name", "party", "current_chamber", "first_year", "last_year")


def _taken_in(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    new = c.select((F.col("c_custkey") + 50).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "changed").otherwise(F.lit("other")).alias("c_name"), "c_nationkey")
    same = c.where("c_custkey < 20").select("c_custkey", "c_name", "c_nationkey")
    return intake.taken_in(c, new.where("c_custkey >= 70").unionByName(same), ["c_custkey"])


@query("""SELECT count(*) AS processed, count(*) FILTER (k > (SELECT max(c_custkey) FROM customer)) AS created, count(*) FILTER (k <= (SELECT max(c_custkey) FROM customer) AND NOT same) AS updated, count(*) FILTER (same) AS skipped
FROM (SELECT c_custkey + 50 AS k, false AS same FROM customer WHERE c_custkey + 50 >= 70 UNION ALL SELECT c_custkey, true FROM customer WHERE c_custkey < 20)""")
def intake_log(spark: SparkSession, d: str) -> DataFrame:
    """How many rows an intake created, updated and skipped."""
    return _taken_in(spark, d)[1]


@query("SELECT o_orderkey AS revision_id, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) THEN 'Ingested' WHEN o_orderkey % 2 = 0 THEN 'Ingesting' ELSE 'Pending' END AS status FROM orders")
def finalized_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revisions after the newest ground truth is finished."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("revision_id"), k.alias("sequence_number"), (F.col("o_orderstatus") == "F").alias("is_ground_truth"), F.when(k % 2 == 0, "Ingesting").otherwise("Pending").alias("status"))
    return intake.finalized(rows).select("revision_id", "status")


_POINT = "a AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 > 0), b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || '!' ELSE text END AS text FROM documents WHERE doc_id % 5 > 0)"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    row = lambda text: [(k % 10).alias("title_number"), k.cast("string").alias("section_number"), text.alias("text_content"), F.sha2(text, 256).alias("text_hash"), F.lit(None).cast("string").alias("notes_hash"), F.lit(False).alias("is_deleted")]
    return docs.where(k % 7 > 0).select(*row(F.col("text"))), docs.where(k % 5 > 0).select(*row(F.when(k % 3 == 0, said(F.coalesce("text", F.lit("")), "!")).otherwise(F.col("text"))))


@query(f"WITH {_POINT} SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS section_number, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change_type, b.doc_id IS NULL AS is_deleted, sha256(b.text) AS text_hash FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text IS DISTINCT FROM b.text")
def ingested_point(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots that a release point adds to its parent's state."""
    parent, states = _versions(spark, d)
    return intake.ingested_point(parent, states, ["title_number", "section_number"])[0].select("section_number", "change_type", "is_deleted", "text_hash")


_SPACED = "trim(regexp_replace(coalesce({t}, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"WITH {_POINT}, x AS (SELECT coalesce(a.doc_id, b.doc_id) % 10 AS title_number, a.doc_id AS i, b.doc_id AS j, {_SPACED.format(t='a.text')} AS s, {_SPACED.format(t='b.text')} AS t FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id) SELECT title_number, count(*) FILTER (i IS NOT NULL AND j IS NOT NULL AND s = t) AS matched, count(*) FILTER (i IS NOT NULL AND j IS NOT NULL AND s <> t) AS differing, count(*) FILTER (i IS NULL) AS missing, count(*) FILTER (j IS NULL) AS extra FROM x GROUP BY 1")
def validated_titles(spark: SparkSession, d: str) -> DataFrame:
    """Stored titles against those of a release point."""
    return intake.validated_titles(*_versions(spark, d)).drop("first_difference")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type <> 'view' OR user_id % 3 > 0")
def session_verifications(spark: SparkSession, d: str) -> DataFrame:
    """Verifications of known sessions in their order."""
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("verified_at"), F.col("event_id").alias("verifier"), "event_type")
    sessions = e.where("session_id % 3 > 0").select("session_id").distinct()
    out, _ = intake.verifications(e.where("event_type <> 'view'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), sessions)
    return out.select(F.col("session_id").alias("user_id"), F.col("verifier").alias("event_id"), F.col("position").cast("long").alias("position"))


@query("SELECT o_orderkey, 'section 10' || o_orderkey || ',section 10' AS links, 'See [[section 10' || o_orderkey || ']] and [[section 10]].' AS text FROM orders")
def linked_references(spark: SparkSession, d: str) -> DataFrame:
    """References in a content as links, the longer first."""
    k = F.col("o_orderkey")
    links, text = intake.linked(said("See section 10", k, " and section 10."), F.array(F.lit("section 10"), said("section 10", k), F.lit("")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(links, ",").alias("links"), text.alias("text"))


# From laws to changes


def _laws(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    edit = F.when(k % 3 == 0, said("Section ", k, " of title 17 is amended by striking \"", F.col("p_brand"), "\" and inserting \"", F.col("p_type"), "\".")).when(k % 3 == 1, said("Section ", k, "-a is hereby repealed.")).otherwise(said("Nothing is done by act no. ", k, " but words are struck and amended."))
    return table(spark, d, "part").select(k.alias("law_id"), edit.alias("text"))


def _processed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seen = table(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("law_id"))
    return process.process_laws(_laws(spark, d), seen, F.lit(26))


@query("""SELECT p_partkey AS law_id, CASE WHEN p_partkey % 3 = 0 THEN 17 ELSE 26 END AS title_number, p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '–a' END AS section_number, CASE WHEN p_partkey % 3 = 0 THEN 'Modify' ELSE 'Repeal' END AS change_type, 'made' AS status,
  CASE WHEN p_partkey % 3 = 0 THEN 'Modify 17 U.S.C. § ' || p_partkey || ': "' || p_brand || '" → "' || p_type || '"' ELSE 'Repeal 26 U.S.C. § ' || p_partkey || '–a' END AS description FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 10 > 0""")
def processed_laws(spark: SparkSession, d: str) -> DataFrame:
    """Changes that laws not processed yet make."""
    return _processed(spark, d)[0].select("law_id", "title_number", "section_number", "change_type", "status", "description")


@query("""SELECT p_partkey AS law_id, CAST(CASE WHEN p_partkey % 3 < 2 THEN 1 ELSE 0 END AS BIGINT) AS edits, CAST(CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 1 END AS BIGINT) AS flagged, CASE WHEN p_partkey % 3 = 2 THEN 'LLM' WHEN p_partkey % 3 = 0 AND 100.0 * length('by striking "' || p_brand || '" and inserting "' || p_type || '"') / length('Section ' || p_partkey || ' of title 17 is amended by striking "' || p_brand || '" and inserting "' || p_type || '".') < 85 THEN 'LLM' END AS next_mode FROM part WHERE p_partkey % 10 > 0""")
def parse_sessions(spark: SparkSession, d: str) -> DataFrame:
    """What each law's parse covered, and where it goes next."""
    return _processed(spark, d)[1].select("law_id", "edits", "flagged", "next_mode")


@query("SELECT l_orderkey, l_linenumber, p_name AS heading FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size = l_suppkey % 50 + 1")
def impact_details(spark: SparkSession, d: str) -> DataFrame:
    """Changes of laws with the headings of their sections."""
    changes = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50 + 1).cast("int").alias("title_number"), F.col("l_partkey").alias("section_number"))
    sections = table(spark, d, "part").select(F.col("p_size").alias("title_number"), F.col("p_partkey").alias("section_number"), F.col("p_name").alias("heading"))
    return process.impact_detail(changes, sections).select("l_orderkey", "l_linenumber", "heading")


@query("SELECT o_orderkey, n_name AS to_heading FROM orders JOIN nation ON n_regionkey = o_orderkey % 9 AND n_nationkey = o_custkey % 40")
def section_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """References of sections to others."""
    refs = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9).cast("int").alias("to_title"), (F.col("o_custkey") % 40).cast("int").alias("to_section"))
    sections = table(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("title_number"), F.col("n_nationkey").cast("int").alias("section_number"), F.col("n_name").alias("heading"))
    return process.dependencies(refs, sections).select("o_orderkey", "to_heading")


# Sources, blame and positions


@query("""SELECT '119-' || c_custkey || 'not' || (c_custkey % 7) || 'u2' AS full_identifier, 119 AS congress, CAST(c_custkey AS INTEGER) AS law_number, CAST(c_custkey % 7 AS VARCHAR) AS not_laws, 2 AS update_number, DATE '2020-01-01' + CAST(c_custkey % 300 AS INTEGER) AS publication_date, CASE WHEN c_nationkey = 9 THEN '9' ELSE array_to_string(list_sort([9, c_nationkey]), ',') END AS titles FROM customer""")
def release_point_index(spark: SparkSession, d: str) -> DataFrame:
    """Release points out of the links of index pages, one of each nation; each is linked twice."""
    k = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 300).cast("int")), "MM/dd/yyyy")
    link = said('<li><a href="prior/usc-rp@119-', k, "not", k % 7, 'u2.htm" title="x">Public Law 119-', k, " (", day, "), affecting titles 9, ", F.col("c_nationkey"), ".</a></li>")
    pages = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.flatten(F.collect_list(F.array(link, link))), "\n").alias("html"))
    out = release_point_links(pages)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("full_identifier", "congress", "law_number", listed("not_laws").alias("not_laws"), "update_number", "publication_date", listed("titles").alias("titles"))


@query(f"""WITH {standins.SNAPSHOTS_SQL}, {standins.REVISIONS_SQL.replace('{head}', '30')}, s AS (SELECT s.*, chain_pos, row_number() OVER (PARTITION BY title_number, section_number ORDER BY chain_pos DESC, snapshot_id DESC) AS n, count(*) OVER (PARTITION BY title_number, section_number) AS newest FROM snapshots s JOIN chain USING (revision_id)),
l AS (SELECT title_number, section_number, revision_id, n, newest, 0 AS line_number, 'Title ' || title_number AS line FROM s UNION ALL SELECT title_number, section_number, revision_id, n, newest, 2, 'Parity ' || snapshot_id % 2 FROM s),
r AS (SELECT *, n - row_number() OVER (PARTITION BY title_number, section_number, line ORDER BY n) AS run FROM l), g AS (SELECT title_number, section_number, line, run, max(n) AS last, max(newest) AS newest, min_by(revision_id, n) AS since_revision FROM r GROUP BY 1, 2, 3, 4)
SELECT l.title_number, l.section_number, l.line_number, l.line, g.since_revision FROM l JOIN g ON g.title_number = l.title_number AND g.section_number = l.section_number AND g.line = l.line AND g.last = g.newest WHERE l.n = l.newest""")
def section_blame(spark: SparkSession, d: str) -> DataFrame:
    """Since which revision each line of each section has stayed."""
    from ..operators import snapshots

    rows = standins.snapshots(spark, d).withColumn("text_content", said("Title ", F.col("title_number"), "\n\nParity ", F.col("snapshot_id") % 2))
    chain = snapshots.revision_chain(standins.revisions(spark, d), 30)
    return snapshots.blame(rows, chain).select("title_number", "section_number", "line_number", "line", "since_revision")


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations), l AS (SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, ls FROM t),
s AS (SELECT conv_id, turn, i, CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS b, length(ls[i]) AS n, ls[i] AS line FROM l)
SELECT conv_id, turn, p.at, line_number FROM (SELECT conv_id, turn, b, n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS line_number FROM s WHERE trim(line) <> '') s JOIN (SELECT unnest([0, 300, 5000]) AS at) p ON p.at >= b AND p.at < b + n""")
def lines_of_positions(spark: SparkSession, d: str) -> DataFrame:
    """The lines in which some positions of each turn stand."""
    rows = table(spark, d, "conversations")
    spans = apply.lines_of(rows, ["conv_id", "turn"], "text").select("conv_id", "turn", "line_number", F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    points = rows.select("conv_id", "turn", F.explode(F.array(*map(F.lit, (0, 300, 5000)))).alias("at"))
    return intervals.points_in(points, spans, ["conv_id", "turn"], "at", "start", "end").select("conv_id", "turn", "at", F.col("line_number").cast("long").alias("line_number"))
