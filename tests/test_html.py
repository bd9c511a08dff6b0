from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from listweave.functions import html as names
from listweave.functions.html import list_links, page_headings, tree
from listweave.functions.times import iso_date
from listweave.plans.normalise import board_listings, with_typed_board_columns
from listweave.sources.html_pages import card_items, card_pages, parsed_details


def card(urn, body=""):
    return f'<li><div class="base-card" {names.CARD_KEY}="{urn}">{body}</div></li>'


FULL = f"""
<a class="x {names.CARD_LINK[0]}" href="https://example.org/v/1?a=1#top">go</a>
<h3 class="{names.CARD_TITLE[0]}"> Data &amp; <b>AI</b>
 Lead </h3>
<h4 class="{names.CARD_COMPANY[0]}"><a> Acme </a></h4>
<span class="{names.CARD_LOCATION[0]}"> Oslo </span><time datetime="2026-03-30">1 day</time>
"""


def cards_of(spark, html):
    pages = spark.createDataFrame([("q", html)], "query string, payload string")
    return [r.asDict() for r in card_items(card_pages(pages)).orderBy("pos").collect()]


def test_full_card(spark):
    assert cards_of(spark, card("urn:li:jobPosting:77", FULL)) == [
        {
            "query": "q", "pos": 0, "job_id": "77", "title": "Data &AILead",
            "company": "Acme", "location": "Oslo", "publish_time": "2026-03-30",
            "url": "https://example.org/v/1",
        }
    ]


def test_missing_fields_are_blank(spark):
    (only,) = cards_of(spark, card("5"))
    assert only["job_id"] == "5"
    assert {only[c] for c in ("title", "company", "location", "publish_time", "url")} == {""}


def test_items_without_a_key_are_left_out(spark):
    html = "<li>ad</li>" + card("") + card("urn:x:") + "<li><div>none</div></li>" + card("a:9")
    assert [(c["job_id"], c["pos"]) for c in cards_of(spark, html)] == [("9", 0)]
    assert cards_of(spark, "") == [] and cards_of(spark, None) == []


def test_nested_items_and_duplicates_stay(spark):
    html = f"<li><ul>{card('a:1')}{card('a:2')}</ul></li>" + card("a:1")
    assert [c["job_id"] for c in cards_of(spark, html)] == ["1", "1", "2", "1"]


def criterion(header, value=None, kind=-1):
    """A criterion in either order of header and value, in tags of any kind."""
    head = f'<dt class="{names.CRITERION_HEADER[0]}"> {header}\n</dt>'
    text = "" if value is None else f'<dd class="y {names.CRITERION_VALUE[kind]}">{value} </dd>'
    parts = (head, text) if kind else (text, head)
    return f'<dl class="{names.CRITERION[0]} z">{"".join(parts)}</dl>'


DETAIL = (
    criterion("Job function", "IT", 0)
    + criterion("Seniority Level", "Entry")
    + f"""<p>unclosed <section class="x {names.DETAIL_TEXT[0]}"> First<br>second &lt;b&gt;
 <ul><li> third </li></ul><!-- not this --><script>var a = "</p>";</script></section>"""
    + criterion("seniority level", "Director", 0)
    + criterion("No value")
    + "<aside>"
    + criterion("On-site/Remote", "Hybrid")
    + criterion("Employment type", "Full-time", 0)
    + "</aside>"
)


def detail_of(spark, html):
    df = spark.createDataFrame([("1", html)], "job_id string, payload string")
    return parsed_details(df).first().asDict()


def test_detail(spark):
    got = detail_of(spark, DETAIL + f'<p class="{names.APPLICANTS[0]}"> Over 200 applicants </p>')
    assert got == {
        "job_id": "1", "description": "First\nsecond <b>\nthird", "experience_level": "Director",
        "employment_type": "Full-time", "skills": "IT", "applicant_count": "Over 200 applicants",
        "workplace_type": "Hybrid",
    }


def test_badge_wins_even_if_empty(spark):
    badge = f'<b class="{names.WORKPLACE[0]}"> Remote </b>'
    assert detail_of(spark, DETAIL + badge)["workplace_type"] == "Remote"
    badge = f'<b class="{names.WORKPLACE[1]}"> </b>'
    assert detail_of(spark, DETAIL + badge)["workplace_type"] == ""


def test_reached_limit_and_long_description(spark):
    html = (
        f'<i class="{names.APPLICANTS[1]}">Full</i>'
        f'<div class="{names.DETAIL_TEXT[0]}">{"é" * 600}</div>'
    )
    got = detail_of(spark, html)
    assert (got["applicant_count"], got["description"]) == ("Full", "é" * 500)


def test_empty_detail_is_blank(spark):
    for html in ("", None, "<html></html>"):
        got = detail_of(spark, html)
        assert {v for k, v in got.items() if k != "job_id"} == {""}


def test_broken_and_nested_markup(spark):
    """An inner item's box is also the first one of an item around it; a box ends with its item."""
    title = f'<h3 class="{names.CARD_TITLE[0]}">'
    html = (
        f"<li>{card('a:1', title + 'one')}{title}outside</h3></li>"
        f'<li><div {names.CARD_KEY}="b:2"><b>{title}two</li>{title}late</h3>'
        f'<li><div {names.CARD_KEY}="c:3"><script>{title}no</script>{title}th<i>re</b>e</h3>'
    )
    got = [(c["job_id"], c["title"]) for c in cards_of(spark, html)]
    assert got == [("1", "one"), ("1", "one"), ("2", "two"), ("3", "three")]


def test_tree_rules():
    page = tree("<div id=a><b>x</i></b><br/><img>y<p>z</div>w")
    assert [e.name for e in page.below()] == ["div", "b", "br", "img", "p"]
    assert page.text("|") == "x|y|z|w"
    assert page.first("div").text() == "xyz"


def test_deep_nesting_does_not_overflow():
    page = tree("<div>" * 5000 + "deep")
    assert page.text() == "deep"


def test_links_and_headings(spark):
    html = '<title> T &amp; U</title><li><a href="/x">A <b>b</b></a><p><a href="/no">n</a></p></li><h1>H'
    df = spark.createDataFrame([(html,), (None,)], "html string")
    rows = df.select(list_links("html").alias("l"), page_headings("html").alias("h")).collect()
    assert [(x.href, x.label) for x in rows[0].l] == [("/x", "Ab")] and rows[1].l == []
    assert tuple(rows[0].h) == ("T & U", "H") and tuple(rows[1].h) == ("", "")


def test_board_record_order_and_blanks(spark):
    df = spark.createDataFrame([("1", None, "2026-03-30")], "job_id string, title string, publish_time string")
    got = board_listings(df, F.lit("2026-03-30T10:00:00+00:00"))
    row = got.first().asDict()
    assert got.columns[:4] == ["job_id", "source", "title", "company"] and len(got.columns) == 14
    assert row["source"] == "linkedin" and row["title"] == "" and row["applicant_count"] == ""
    typed = with_typed_board_columns(got.withColumn("applicant_count", F.lit("Over 1,200 applicants"))).first()
    assert str(typed.publish_date) == "2026-03-30" and typed.applicants == 1200


def parsed_anyway(document, monkeypatch):
    with monkeypatch.context() as patch:
        patch.setattr(names._Reader, "_read_plain", lambda self, document: False)
        return names._cards(document), names._detail(document)


def test_plain_tags_read_as_by_the_parser(monkeypatch):
    dice = random.Random(4)
    tags = "li div a span h3 h4 time br p script style template img LI Div title".split()
    marks = [
        *names.CARD_TITLE, *names.CARD_COMPANY, *names.CARD_LOCATION, *names.CARD_LINK,
        *names.DETAIL_TEXT, *names.CRITERION, *names.CRITERION_HEADER, *names.CRITERION_VALUE,
        *names.APPLICANTS, *names.WORKPLACE,
    ]
    texts = ["one", " two\n", "&amp;", "&lt;x", "&", "a &copy", "3 > 2", '<script>t="</h3>"</script>']
    odd = ["<!-- c -->", "a < b", "<", "</>", "<?p?>", "<a b=c>", "<p class='x'>"]

    def piece(is_odd):
        attrs = dice.choice([
            "", f' class="{dice.choice(marks)} y"', f' {names.CARD_KEY}="urn:{dice.randrange(9)}"',
            ' href="u?a=1&amp;b=2&copy=3"', " hidden",
        ])
        opening = f"<{dice.choice(tags)}{attrs}{dice.choice(['', ' ', '/'])}>"
        closing = f"</{dice.choice(tags)}{dice.choice(['', ' '])}>"
        return dice.choice([opening, closing, dice.choice(texts), dice.choice(odd if is_odd else texts)])

    for turn in range(3000):
        document = "".join(piece(turn % 3 == 0) for _ in range(dice.randrange(1, 26)))
        read = names._cards(document), names._detail(document)
        assert read == parsed_anyway(document, monkeypatch), document


def test_plain_pages_do_without_the_parser(monkeypatch):
    card = f'<li><div {names.CARD_KEY}="urn:1"><h3 class="{names.CARD_TITLE[0]}">A &amp; B</h3></div></li>'
    lines = f'<div class="{names.DETAIL_TEXT[0]}">' + "line<br/>" * 60 + "</div>"
    expected = [parsed_anyway(page, monkeypatch) for page in (card, lines)]
    monkeypatch.setattr(names._Reader, "feed", lambda self, document: pytest.fail("parser"))
    assert [(names._cards(page), names._detail(page)) for page in (card, lines)] == expected
