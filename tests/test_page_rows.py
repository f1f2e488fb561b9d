"""Page facts and page identity."""

import hashlib

from larkspur.functions.dom import page_facts
from larkspur.operators.lookups import changed_pages


def test_a_paragraph_ends_where_the_next_begins():
    """An unclosed bold text does not join short paragraphs to a description."""
    page = "<article><h1>T</h1><p><b>And there it is by the sea.<br><p>A short one of under forty.</p><p>And the end.</p></article>"
    assert page_facts(page)["description"] is None
    assert page_facts(page + "<p>" + "x" * 40 + "<table><tr><td><p>a</p>")["description"] == "x" * 40


def test_a_page_with_several_known_hashes_is_one_row(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "v", None), (4, "w", "c")], "page_id int, url string, html string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    known = spark.createDataFrame([("u", sha("a")), ("u", sha("x")), ("w", sha("old"))], "url string, html_hash string")
    rows = changed_pages(pages, known).collect()
    assert len(rows) == 3 and {(r.page_id, r.is_new) for r in rows} == {(2, False), (3, True), (4, False)}
