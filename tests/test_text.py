"""Linked references, trees of lines and edits at anchors, against plain versions on random input."""

import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import anchored, apply, blame, extract, line_tree, links, prose, xml_edits

# Linked references


def plain_links(text, names):
    """Names by falling length, then as listed; each occurrence that overlaps none before it."""
    kept = []
    for k, n in sorted(enumerate(names), key=lambda x: -len(x[1])):
        at = text.find(n) if n else -1
        while at >= 0:
            if not any(at < e and at + len(n) > s for s, e, _ in kept):
                kept.append((at, at + len(n), k))
            at = text.find(n, at + 1)
    return sorted(kept)


def test_links_of_random_overlapping_names():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab §") for _ in range(rng.randrange(n)))
    for _ in range(3000):
        text, names = word(40), [word(6) for _ in range(rng.randrange(6))]
        assert links.chosen(text, names) == plain_links(text, names), (text, names)
        cut = links.cut_up(text, names)
        assert "".join(p[3] for p in cut) == text and [p[0] for p in cut[1:]] == [p[1] for p in cut[:-1]]


@pytest.mark.parametrize(("text", "names"), [("the Act of the State " * 50_000, ["the Act", "the Act of the State", "State", "Act of"]), ("a" * 300_000, ["aa", "aaa", "a" * 8]), ("ab" * 200_000, ["ba" * 400 + "c", "abab"])])
def test_long_texts_take_linear_time(text, names):
    began = time.process_time()
    assert "".join(p[3] for p in links.cut_up(text, names)) == text
    assert time.process_time() - began < 30


REFERENCE = "k int, position int, display_text string, ref_type string, target_id string, usc_title int, usc_section string, congress int, law_number int, resolvable boolean"


def test_links_and_their_routes(spark):
    texts = spark.createDataFrame([(1, "See section 5 of title 17, and Pub. L. 94–553; section 5 too."), (2, "none"), (3, None), (4, ""), (5, "an Act, 5 Stat. 3, 😀 section 9")], "k int, text string")
    rows = [
        (1, 1, "section 5", "usc_section", "a", 5, "5", None, None, True), (1, 0, "section 5 of title 17", "usc_section", "b", 17, "5", None, None, None), (1, 2, "Pub. L. 94–553", "public_law", "c", None, None, 94, 553, True),
        (1, 3, "section 5", "act", "late", None, None, None, None, True), (1, 4, "", "act", "empty", None, None, None, None, True), (1, 5, None, "act", "null", None, None, None, None, True),
        (5, 0, "an Act", "act", "d", None, None, None, None, True), (5, 1, "section 9", "usc_section", "e", 1, "9", None, None, False), (5, 2, "5 Stat. 3", "public_law", "f", None, None, 0, 3, True), (9, 0, "x", "act", "g", None, None, None, None, True),
    ]
    cut = links.linked_pieces(texts, spark.createDataFrame(rows, REFERENCE), ["k"], revision=F.lit(8))
    got = {r["k"]: (r["links"], r["linked_text"]) for r in links.linked_text(cut, ["k"]).collect()}
    assert got == {
        1: (3, "See [section 5 of title 17](/sections/17/5?rev=8), and [Pub. L. 94–553](/laws/94/553?rev=8); [section 5](/sections/5/5?rev=8) too."), 2: (0, "none"),
        5: (0, "an Act, 5 Stat. 3, 😀 section 9"),
    }
    assert {(r["said"], r["target_id"]) for r in cut.where("k = 5 and target_id is not null").collect()} == {("an Act", "d"), ("section 9", "e"), ("5 Stat. 3", "f")}
    assert links.linked_pieces(texts.where("false"), spark.createDataFrame(rows, REFERENCE), ["k"]).count() == 0


# Trees of lines


def test_nested_ranges_are_subtrees():
    rng = random.Random(2)
    for _ in range(300):
        indents = [rng.randrange(6) for _ in range(rng.randrange(30))]
        got = line_tree.nested(indents, [None] * len(indents))
        parents = [max((j for j in range(k) if indents[j] < x), default=-1) for k, x in enumerate(indents)]
        assert [g[0] for g in got] == parents
        for k in range(len(indents)):
            way, at = [], k
            while at >= 0:
                way.append(at)
                at = parents[at]
            assert sorted(way) == [j for j in range(len(indents)) if j <= k <= got[j][1]] and got[k][2] == len(way) - 1


def test_paths_of_markers():
    paths = [x[3] for x in line_tree.nested([0, 1, 2, 3, 2, 2, 1], [None, "(a)", "(1)", "(A)", None, "(b)(2)", "(c)"])]
    assert paths == ["", "(a)", "(a)(1)", "(a)(1)(A)", "(a)", "(b)(2)", "(c)"]


@pytest.mark.parametrize(("text", "want"), [
    ("", []), ("  ", []), ("One. Two.", [("One.", 0, None), ("Two.", 0, None)]), ("(1) x (2) y", [("(1) x", 1, "(1)"), ("(2) y", 1, "(2)")]), ("(a)", [("(a)", 1, "(a)")]),
    ("under paragraphs (1) and (2) of it", [("under paragraphs (1) and", 0, None), ("(2) of it", 1, "(2)")]), ("See Pub. L. 9–5 now. (3) is", [("See Pub. L. 9–5 now.", 0, None), ("(3) is", 1, "(3)")]),
    ("(a)(1) Scope—It holds for all.", [("(a)(1) Scope", 1, "(a)(1)"), ("It holds for all.", 2, None)]), ("(hereinafter) x\n\n y.", [("(hereinafter) x", 0, None), ("y.", 0, None)]), ("(ii) x", [("(ii) x", 1, "(ii)")]),
])
def test_prose_lines(text, want):
    got = line_tree.prose_lines(text)
    assert [(x[1], x[2], x[3]) for x in got] == want and [x[0] for x in got] == list(range(1, len(got) + 1))
    assert all(0 <= x[5] <= x[6] <= len(text) for x in got)


def test_sentences_go_on_after_abbreviations_and_references():
    said = lambda t: [x[0] for x in prose.sentence_spans(t)]
    assert said("as in par. (a)(2). Pub. L. 9 did it. See (1) of it. (2) of it, too.") == ["as in par. (a)(2). Pub. L. 9 did it.", "See (1) of it. (2) of it, too."]
    assert said("It is so (a). So it is.") == ["It is so (a).", "So it is."] and said("A v. B. “C.” (See D.)") == ["A v. B.", "“C.” (See D.)"]


def test_offsets_of_sentences_are_theirs():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(["A b.", " ", "\n\n", "Pub. L.", "Sec.", " (1)", "“Q.”", " c", "(a)(2).", " X"]) for _ in range(rng.randrange(14)))
        spans = prose.sentence_spans(text, 5)
        assert all(text[s - 5 : e - 5] == words for words, s, e in spans)
        assert "".join("".join(w for w, _, _ in spans).split()) == "".join(text.split())


def test_long_prose_takes_linear_time():
    text = "".join(f"({k % 900}) The {k}th item stands. It goes on under paragraph (3). " for k in range(40_000))
    began = time.process_time()
    assert len(line_tree.prose_lines(text)) == 80_000
    assert time.process_time() - began < 20


def test_sections_with_and_without_levels(spark):
    rows = [(1, "(a) x", None), (2, "prose here", []), (3, None, None), (4, "unused", [(0, "level", "(a)", None, "It is."), (2, "level", "(A)", "HEAD.—", None), (0, "closing", None, None, "End.")])]
    d = spark.createDataFrame(rows, f"k int, text_content string, levels array<{line_tree.LEVEL}>")
    got = line_tree.section_lines(d, ["k"], levels="levels").orderBy("k", "line_number").collect()
    assert [(r["k"], r["line_number"], r["content"], r["indent_level"], r["parent"], r["path"]) for r in got] == [
        (1, 1, "(a) x", 1, None, "(a)"), (2, 1, "prose here", 0, None, None), (4, 1, "(a) It is.", 0, None, "(a)"), (4, 2, "(A) Head", 2, 1, "(a)(A)"), (4, 3, "End.", 0, None, None),
    ]
    assert line_tree.section_lines(d, ["k"]).count() == 3 and line_tree.section_lines(d.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize(("raw", "want"), [("GENERAL RULES FOR PART XIV.", "General Rules For Part XIV"), ("Mixed Case OF it.—", "Mixed Case OF it"), ("Sec­tion 5", "Section 5"), ("", ""), ("I DO", "I Do")])
def test_headings_of_levels(raw, want):
    assert line_tree.clean_heading(raw) == want


# Edits at anchors


def test_keys_between_any_two():
    rng = random.Random(4)
    for n in (0, 1, 61, 62, 5000):
        keys = anchored.first_keys(n)
        assert keys == sorted(set(keys)) and len(keys) == n and all(k and k[-1] != "0" for k in keys)
    keys = anchored.first_keys(3)
    for _ in range(3000):
        at = rng.choice([0, len(keys), rng.randrange(len(keys) + 1)])
        low, high = keys[at - 1] if at else "", keys[at] if at < len(keys) else None
        new = anchored.between(low, high)
        assert low < new and (high is None or new < high) and new[-1] != "0"
        keys.insert(at, new)
    for n in range(1, 60):
        at = rng.randrange(len(keys))
        many = anchored.new_keys(keys[at - 1] if at else "", keys[at], n, n)
        assert len(many) == n and [*keys[:at], *many, *keys[at:]] == sorted(set(keys) | set(many))
    assert max(map(len, anchored.new_keys("", None, 2000, 7))) < 30


def replayed(lines, changes):
    """The same changes on a plain list of [marker, content, made by, changed by], places found anew each time."""
    lines = [list(x) for x in lines]

    def span(m):
        begin = next((i for i, x in enumerate(lines) if x[0] == f"({m})"), None)
        if begin is None:
            return None
        kind = lambda y: 0 if y.isdigit() else 1 if y.isupper() else 2
        end = begin + 1
        while end < len(lines) and not (lines[end][0] and lines[end][0] != f"({m})" and kind(lines[end][0].strip("()")) == kind(m)):
            end += 1
        return begin, end

    for c in sorted(changes, key=lambda c: c["change_type"] != "Redesignate"):
        by = c["change_id"]
        if c["change_type"] == "Redesignate":
            to = dict(zip(c["old_markers"], c["new_markers"], strict=True))
            for x in lines:
                if x[0] in to:
                    new = to[x[0]]
                    if new != x[0]:
                        x[1], x[0], x[3] = new + x[1][len(x[0]) :], new, by
        elif c["change_type"] == "Add":
            found = span(c["anchor"].strip("()")) if c["anchor"] else None
            at = len(lines) if found is None else found[c["position"] == "after"]
            m = c["new_text"].split(" ")[0]
            lines.insert(at, [m, c["new_text"], by, by])
        elif c["old_text"] is not None:
            for x in lines:
                if c["old_text"] in x[1]:
                    x[1], x[3] = x[1].replace(c["old_text"], c["new_text"] or ""), by
        else:
            found = span(c["old_markers"][0].strip("()"))
            if found:
                lines[found[0] : found[1]] = []
    return lines


def test_random_edits_equal_a_plain_replay():
    rng = random.Random(5)
    marks = [f"({m})" for m in "abcdefghAB12"]
    blank = dict.fromkeys(anchored.CHANGE)
    for _ in range(400):
        first = rng.sample(marks, rng.randrange(1, 8))
        keys = anchored.first_keys(len(first))
        lines = [{"line_key": k, "line_number": n, "marker": m, "content": f"{m} text {n}", "indent_level": 0, "created_by": None, "changed_by": None} for n, (k, m) in enumerate(zip(keys, first, strict=True), 1)]
        plain, kept = [[m, f"{m} text {n}", None, None] for n, m in enumerate(first, 1)], {}
        number = 0
        for _law in range(4):
            changes = []
            for _ in range(rng.randrange(1, 4)):
                number += 1
                a, b = rng.sample(marks, 2)
                changes.append(blank | {"change_id": number} | rng.choice([
                    {"change_type": "Add", "new_text": f"{a} new {number}", "position": rng.choice(["after", "before"]), "anchor": b}, {"change_type": "Redesignate", "old_markers": [a, b], "new_markers": [b, a]},
                    {"change_type": "Modify", "old_text": f"text {rng.randrange(8)}", "new_text": f"words {number}"}, {"change_type": "Delete", "old_markers": [a]},
                ]))
            kept = {x["line_key"]: x["created_by"] for x in lines}
            lines, _ = anchored.applied(lines, changes)
            plain = replayed(plain, changes)
            assert [[x["marker"], x["content"], x["created_by"], x["changed_by"]] for x in lines] == plain
            assert [x["line_key"] for x in lines] == sorted(x["line_key"] for x in lines) and [x["line_number"] for x in lines] == list(range(1, len(lines) + 1))
            # A line that stays keeps its key and what made it.
            assert all(kept[x["line_key"]] == x["created_by"] for x in lines if x["line_key"] in kept)


def test_changes_without_a_place(spark):
    lines = spark.createDataFrame([(1, 1, "(a)", "(a) one", 0), (1, 2, None, None, 0), (2, 1, None, "as it was", 0)], "k int, line_number int, marker string, content string, indent_level int")
    kinds = "k int, change_id long, change_type string, old_text string, new_text string, position string, anchor string, old_markers array<string>, new_markers array<string>, instruction string"
    rows = [
        (1, 1, "Modify", "x", "y", None, None, None, None, None), (1, 2, "Delete", None, None, None, None, ["(z)"], None, None), (1, 3, "Add", None, "", None, None, None, None, None), (1, 4, "Redesignate", None, None, None, None, ["(a)"], None, None),
        (1, 5, "Add", None, "(q) here", "after", "(zz)", None, None, None), (3, 6, "Add", None, "(a) of a new section", None, None, None, None, None), (1, 7, "Repeal", None, None, None, None, None, None, None), (1, 8, "Redesignate", None, None, None, None, None, None, "by designating the first sentence as subsection (b)"),
    ]
    after, done = anchored.apply_anchored(anchored.keyed(lines, ["k"]), spark.createDataFrame(rows, kinds), ["k"])
    assert sorted((r["k"], r["line_number"], r["marker"], r["content"]) for r in after.collect()) == [(1, 1, "(b)", "(b) (a) one"), (1, 2, None, None), (1, 3, "(q)", "(q) here"), (2, 1, None, "as it was"), (3, 1, "(a)", "(a) of a new section")]
    assert {r["change_id"]: r["placed"] for r in done.collect()} == {1: False, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False, 8: True}


# Quotations


@pytest.mark.parametrize(("text", "want"), [
    ("x: “a “b ``c'' d” e” tail", ("a “b ``c'' d” e", 0.9)), ('x: "a “b” c" tail', ("a “b” c", 0.9)), ("x: “never closed. And so on", None), ("x: “open “inner.” and on", ("open “inner.", 0.7)), ("x ``one'' two", ("one", 0.9)),
    ("x: the words\nof it\n(c) next", ("the words\nof it", 0.6)), ("x: the words\nSEC. 5. next", ("the words", 0.6)), ("x which reads so\nand so\n\nmore", ("which reads so\nand so", 0.5)), ("x short\n\nmore", None),
])
def test_texts_that_follow(text, want):
    got = prose.introduced(text, 1)
    assert (got and got[:2]) == want


def test_long_quotations_take_linear_time():
    for text in ("x: " + "“a " * 300_000 + "”" * 300_000, "x: " + "“a " * 300_000, 'x: "' + "b. " * 300_000 + '"'):
        began = time.process_time()
        prose.introduced(text, 1)
        assert time.process_time() - began < 10


def test_instructions_are_read_by_their_words():
    assert prose.designated("by designating the first, second and third sentences as subsections (a), (b), and (c), respectively") == [(0, "(a)"), (1, "(b)"), (2, "(c)")]
    assert prose.designated("designating the first and second sentences as subsection (a)") is None and prose.designated("by designating the place") is None
    assert prose.struck("in striking out; by striking subsections (a), (b), and (c) and inserting") == ["a", "b", "c"] and prose.struck("striking subsections of it") is None


# Instructions in XML

A, Q = '<amendingAction type="{}">{}</amendingAction>', "<quotedText>“{}”</quotedText>"
STRIKE, INSERT, ADD, AMEND, REPEAL = A.format("delete", "striking"), A.format("insert", "inserting"), A.format("add", "adding"), A.format("amend", "amended"), A.format("repeal", "repealed")
REF = '<ref href="/us/usc/t17/s220">section 220</ref>'


@pytest.mark.parametrize(("body", "want"), [
    (f"Section <ref href='/us/usc/t17/s220'>220</ref>(b)(1) is {AMEND} by {STRIKE} {Q.format('A')} and {INSERT} {Q.format('B')} after {Q.format('C')}.", [("Modify", 17, "220", "(b)(1)", "A", "B", "after", "C", None, 0.98, False)]),
    (f"{REF} is {AMEND} by {INSERT} after {Q.format('C')} the following: {Q.format('B')}.", [("Add", 17, "220", None, None, "B", "after", "C", None, 0.95, True)]),
    (f"{REF} is {AMEND} by {INSERT} {Q.format('B')} before {Q.format('C')} each place it appears.", [("Add", 17, "220", None, None, "B", "each_place", None, None, 0.95, True)]),
    (f"<chapeau>{REF} is {AMEND}—</chapeau><paragraph><num>(1)</num> in paragraph (3)—<subparagraph>in subparagraph (B), by {STRIKE} {Q.format('x')};</subparagraph><subparagraph>by {ADD} at the end <quotedContent>“<p>“(C) new</p>”</quotedContent>.</subparagraph></paragraph>",
     [("Delete", 17, "220", "(3)(B)", "x", None, None, None, None, 0.95, False), ("Add", 17, "220", "(3)", None, "(C) new", "at_end", None, None, 0.95, True)]),
    (f'Section <ref href="/us/usc/t17/s220/b"/> is {AMEND} in paragraph (2)(A), by {STRIKE} the period at the end.', [("Delete", 17, "220", "(b)(2)(A)", None, None, "unquoted_target", None, "the period at the end", 0.90, False)]),
    (f"{REF} is {AMEND} by {ADD} after subsection (c) the following new subsection (d): {Q.format('(d) It is.')}", [("Add", 17, "220", None, None, "(d) It is.", "after", "(c)", None, 0.95, True)]),
    (f"Section 9(a) of title 5 is {REPEAL}.", [("Repeal", 5, "9", "(a)", None, None, None, None, None, 0.90, False)]),
    (f"The Act is {AMEND} by {A.format('substitute', 'substituting')} {Q.format('a')} {Q.format('b')}.", [("Modify", None, None, None, "a", "b", None, None, None, 0.49, True)]),
    (f"{REF} is {AMEND} as follows: {Q.format('a')} {Q.format('b')}.", [("Modify", 17, "220", None, "a", "b", None, None, None, 0.98, True)]),
    (f"{REF} is {AMEND} by {A.format('redesignate', 'redesignating')} subsection (c) as subsection (d).", [("Redesignate", 17, "220", "(c)", None, None, None, None, None, 0.90, False)]),
    ("Nothing is said here.", []),
])
def test_leaves_of_instructions(body, want):
    got = xml_edits.edits_of(f'<law xmlns="http://schemas.gpo.gov/xml/uslm"><section role="instruction">{body}</section></law>')
    assert [(*r[:7], r[10], r[11], r[7], r[12]) for r in got] == want and [r[13] for r in got] == list(range(len(got)))


def test_long_instructions_take_linear_time():
    body = "".join(f"<paragraph>in paragraph ({k}), by {STRIKE} {Q.format(k)};</paragraph>" for k in range(20_000))
    began = time.process_time()
    assert len(xml_edits.edits_of(f'<law xmlns="http://schemas.gpo.gov/xml/uslm"><section role="instruction">{REF} is {AMEND}—{body}</section></law>')) == 20_000
    assert time.process_time() - began < 20


# Places and lists of edits in prose


@pytest.mark.parametrize(("text", "want"), [
    ('Section 5 of title 17, United States Code, as amended by section 3 of the Good Act (Pub. L. 101–5), is amended by striking "x" and inserting "y".', [("strike_insert", 17, "5", None, "x", "y")]),
    ("Section 5(c) of title 17 is amended by striking paragraphs (2) and (3).", [("strike_paragraph", 17, "5", "(c)(2)", None, None), ("strike_paragraph", 17, "5", "(c)(3)", None, None)]),
    ('Section 5 of title 17 is amended by striking "a", "b", and "c".', [("strike", 17, "5", None, x, None) for x in "abc"]),
    ("Sections 106 through 108 of title 17 are repealed.", [("repeal", 17, x, None, None, None) for x in ("106", "107", "108")]),
    ("Sections 5, 7, and 9a of title 3 are hereby repealed.", [("repeal", 3, x, None, None, None) for x in ("5", "7", "9a")]),
    ('Section 5 of title 17 is amended. Section 6 of such title is amended by striking "q".', [("section_amended_general", 17, "5", None, None, None), ("strike", 17, "6", None, "q", None)]),
    ('Title 26, United States Code, is amended— (1) in section 101(b), by striking "q"; and (2) in section 102, by inserting "r".', [("title_amended", 26, None, None, None, None), ("strike", 26, "101", "(b)", "q", None), ("insert", 26, "102", None, None, "r")]),
    ('Section 5, relating to section 9, is amended by striking “the “inner” words”.', [("strike", None, "5", None, "the “inner” words", None)]),
    ("Paragraph (2)(B) of section 5(a) of title 9 is repealed.", [("paragraph_repealed", 9, "5", "(a)(2)(B)", None, None)]),
    ("The board is amended in its views; nothing is repealed.", []), ("striking", []), ("", []), ('Section 5 of title 17 is amended by striking "never closed', [("section_amended_by", 17, "5", None, None, None)]),
    ("Section 5 of title 17 is amended by redesignating paragraphs (2) through (4) as paragraphs (3) through (5).", [("redesignate_paragraph", 17, "5", None, "(2) through (4)", "(3) through (5)")]),
])
def test_places_and_lists_of_edits(text, want):
    assert [(r[0], r[2], r[3], r[4], r[5], r[6]) for r in extract._matches(text)] == want


@pytest.mark.parametrize("part", ['Section 5 of title 17 is amended by striking "x" and inserting "y". ', "striking “ ", 'striking "x", ', "section 5 ", "paragraph (1) of ", "is amended ", "by striking paragraphs (1), "])
def test_long_laws_take_linear_time(part):
    began = time.process_time()
    extract._matches(part * 10_000)
    once = time.process_time() - began
    assert once < 20


# Differences of lines


def longest_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("cells", [6, 1 << 24])
def test_common_lines_are_as_many_as_may_be(monkeypatch, cells):
    monkeypatch.setattr(apply, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(800):
        k = rng.choice([1, 2, 3, 9])
        a, b = ([str(rng.randrange(k)) for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = apply.common_lines(a, b)
        assert len(pairs) == longest_common(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_hunks_are_patches():
    rng = random.Random(9)
    for _ in range(500):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(40))] for _ in range(2))
        if rng.random() < 0.7:
            b = [x for x in a if rng.random() > 0.1] + [rng.choice("xyz")] * rng.randrange(3)
        out, at, last = [], 0, -1
        for n, old_start, old_lines, new_start, new_lines, kind, line in apply.hunks_of("\n".join(a), "\n".join(b)):
            if n != last:
                out += a[at : old_start - 1]
                assert new_start == len(out) + 1
                at, last, ends = old_start - 1, n, (old_start - 1 + old_lines, new_start - 1 + new_lines)
            if kind != "+":
                assert a[at] == line
                at += 1
            if kind != "-":
                out.append(line)
            assert at <= ends[0] and len(out) <= ends[1]
        assert out + a[at:] == b
    assert apply.hunks_of(None, None) == [] and [x[5:] for x in apply.hunks_of(None, "a\nb")] == [("+", "a"), ("+", "b")]


def test_repetitive_lines_take_little_time():
    rng = random.Random(10)
    a, b = ("\n".join(rng.choice("ab") for _ in range(8000)) for _ in range(2))
    began = time.process_time()
    assert len(apply.hunks_of(a, b)) > 8000
    assert time.process_time() - began < 1


def test_lines_keep_their_origin():
    got = blame.blamed([(1, "a\nb\nc"), (2, "a\nB\nc"), (3, "c\na\nB\nd"), (4, "c\nx\na\nB2\nd")])
    assert got == [("c", 1, 1, 3), ("x", 4, 4, None), ("a", 1, 1, None), ("B2", 1, 4, None), ("d", 3, 3, None)]
    assert blame.blamed([]) == [] and blame.blamed([(1, None), (2, "a"), (3, None), (4, "a")]) == [("a", 4, 4, None)]
    assert blame.blamed([(1, "a\na\n\n"), (2, "\na")]) == [("", 2, 2, None), ("a", 1, 1, None)]


def test_random_histories_keep_lines_that_stay():
    rng = random.Random(11)
    for _ in range(200):
        number, now, history, made = 0, [], [], {}
        for revision in range(1, 6):
            now = [x for x in now if rng.random() > 0.2]
            for _ in range(rng.randrange(3)):
                number += 1
                now.insert(rng.randrange(len(now) + 1), f"line {number}")
            made |= {x: revision for x in now if x not in made}
            history.append((revision, "\n".join(now)))
        # All lines differ, so that each one's words were given by the revision in which it first stood.
        assert [(x[0], x[2]) for x in blame.blamed(history)] == [(x, made[x]) for x in now]
