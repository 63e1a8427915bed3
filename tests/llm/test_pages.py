"""Page extraction: known pages, and the minimum cut against all labellings."""

import html
import itertools
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from pointweave.llm import html_mincut
from pointweave.llm.html_mincut import MinCut, label, blocks_of, main_text


def test_table_gives_the_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in html_mincut.query(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, r in pages.items():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        want = " ".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", y)).split()) for y in re.split(r"</?(?:p|h1|h2|br)>", inside)) if x)
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), r.url)


def test_boilerplate_goes():
    page = """<html><head><title>T</title></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
      <div class="cookie-notice"><p>We use cookies to make this site better for you. Accept?</p></div>
      <main><article><header><h1>A &quot;title&quot;</h1></header><p>The first  paragraph has <b>bold</b> and <a href=x>linked</a> words, and an end.<p>The second is not closed &amp; still fine.
      <ul><li>One point of the list is made here.<li>Another one follows it, longer than the first.</ul><form><input><label>Mail</label><button>Send</button></form></article></main>
      <section id="comments"><h2>Comments</h2><p>I liked this a lot, thank you for writing it so well.</p></section>
      <aside class="sidebar"><p>Read also this other story, which is about something else.</p></aside><script>var a = "<p>no</p>";</script><footer>&copy; 2024 All rights reserved.</footer></body></html>"""
    assert main_text(page) == 'A "title" The first paragraph has bold and linked words, and an end. The second is not closed & still fine. One point of the list is made here. Another one follows it, longer than the first.'


def test_heads_without_an_end_and_closed_drawings():
    meat = "<p>The first sentence of the page is long enough to count.</p><p>The second one is, too, and it has an end.</p>"
    want = "The first sentence of the page is long enough to count. The second one is, too, and it has an end."
    head = "<html><head><meta charset=utf-8><title>T</title><link rel=x href=y><style>p {}</style><script>1</script>"
    for page in (f"{head}<body>{meat}</body></html>", f"{head}{meat}", f"{head}<article>{meat}</article>", f"{head}<noscript><img src=x><body>{meat}", f"<head/><body>{meat}", f"{head}</head><body><head>{meat}</body>"):
        assert main_text(page) == want, page
    assert main_text(f"{head}\n A bare sentence ends the head of this page, as in browsers.") == "A bare sentence ends the head of this page, as in browsers."
    drawn = want.replace("page is", "page <svg/>is").replace("one is", 'one <svg width="1"><g><path d="M0"/></g><a/><title/></svg>is')
    assert main_text("<html><head><title>T</title></head><body><article><p>" + drawn.replace(". The", ".</p><p>The") + "</p></article></body></html>") == want


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (4, "u", "<article>" + "<p>A sentence that is long enough to count.</p>" * 3000 + "</article>"), (4, "u", "<div>" * 2000 + "deep and long enough, it is a sentence." + "</div>" * 2000), (5, "u", "</p></div><b><i>x</b></i><![CDATA[z]]><!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS body")
    got = html_mincut.extract(df).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert max(r.n_chars for r in got) == len(" ".join(["A sentence that is long enough to count."] * 3000))
    assert html_mincut.extract(df.filter("false")).collect() == []


def test_time_follows_the_tags_that_stay_open():
    """Elements that never end, 40,000 of them: a page of four times the tags takes about four times as long."""
    for piece in ("<div>A sentence with an end, long enough to count.", "<b><div>A sentence with an end.</b>", "<p><b>A sentence with an end."):
        took = []
        for n in (10_000, 40_000):
            start = time.process_time()
            found = blocks_of(piece * n)
            assert len(found) == n == len(label(found))
            took.append(time.process_time() - start)
        assert took[1] < 9 * took[0] + 0.5, (piece, took)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=7), st.data())
def test_cut_is_the_cheapest_labelling(ends, data):
    n = len(ends)
    joins = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 6)), max_size=10))
    graph = MinCut(n + 2)
    for i, (a, b) in enumerate(ends):
        graph.edge(n, i, a)
        graph.edge(i, n + 1, b)
    for a, b, w in joins:
        graph.edge(a, b, w, w)

    def cost(side):
        return sum(b if s else a for s, (a, b) in zip(side, ends, strict=True)) + sum(w for a, b, w in joins if side[a] != side[b])

    assert cost(graph.source_side(n, n + 1)[:n]) == min(cost(s) for s in itertools.product([True, False], repeat=n))


def test_neighbours_pull_a_weak_block_along():
    found = blocks_of("<article><p>A long sentence which is surely content, as it goes on and on and has an end.</p><p>Yes</p><p>Another long sentence which is surely content, as it goes on as well.</p></article>")
    assert label(found) == [True] * 3
