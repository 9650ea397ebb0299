import html
import re
from collections import Counter

import numpy as np
import pytest
from conftest import FOLDER

from mnemoframe.llm import html_text
from mnemoframe.llm.html_text import main_text

BODY = "Some words of an article that is long enough to stand out from all the rest. " * 3
CASES = [
    (None, ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("plain", "plain"),
    ("<p>a&nbsp;b&#233;&amp;c</p>", "a bé&c"),
    ("<script>var a = '<p>no</p>'</script><style>p{}</style><p>yes", "yes"),
    ("<p>cut off</p><foo", "cut off"), ("<p>kept</p><!-- <p>no</p>", "kept"),
    ("<![CDATA[x]]><p>hi", "hi"), ("<b>bo</b>ld\n  text<br>line", "bold text line"),
    (f"<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>{BODY}</p><p>End.</p></article>"
     f"<div class='comments'><p>{BODY}</p></div><footer>no</footer>", f"T {BODY}End."),
    (f"<div id='side-bar sidebar'><p>{BODY}</p></div><div><p>{BODY}</p></div>", BODY.strip()),
    (f"<article><p>{BODY}</p><div class='advert'>{BODY}</div><form>{BODY}</form>"
     f"<p>End</p></article>", f"{BODY}End"),
    (f"<div><p>{BODY}</p></div><div><a href='/a'>one link</a> <a href='/b'>two links</a></div>",
     BODY.strip()),
    (f"<nav><ul><li>never closed<article><p>{BODY}</p>", BODY.strip()),
    (f"<article><p>{BODY}</p><p><a href='/a'>{BODY}</a></p><p>{BODY}</p></article>", f"{BODY}{BODY}{BODY}".strip()),
    (f"<article><p>{BODY}</p><table>{'<tr><td>7</td></tr>' * 12}</table></article>", BODY + " ".join("7" * 12)),
    (f"<script><!-- var a = 1;</script><article><p>{BODY}</p></article>", BODY.strip()),
    (f"<article><p>{BODY}</p><!-- <p>cut off", BODY.strip()), ("<p>a</p><!----><p>b</p><!--><p>c", "a b c"),
    (f"<div hidden>{BODY}</div><div hidden='hidden'>{BODY}</div><p>seen</p><div hidden=until-found><p>found</p>",
     "seen found"),
    (f"<article><p>{BODY}</p><aside>{BODY * 20}</aside><p>End</p></article><div>{BODY * 20}</div>", f"{BODY}End"),
    (f"<div class='cookieNotice'>{BODY}</div><main><p>{BODY}</p></main>", BODY.strip()),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_clusters_decide_inside_main():
    far = [f"far{i}" for i in range(20)]
    lines = "".join(f"<p>{x}</p>" for x in far)
    found = main_text(f"<main>{lines}{f'<p>{BODY}</p>' * 4}{lines}</main>")
    assert found.count(BODY.strip()) == 4
    # smoothing lets a few lines beside the cluster in
    assert not set(far[6:14]) & set(found.split())


def test_clusters_find_the_articles_without_their_tags(spark):
    kept = missed = more = 0
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        want = Counter(main_text(r["html"]).split())
        found = Counter(main_text(re.sub(r"(</?)article\b", r"\1div", r["html"])).split())
        kept += (want & found).total()
        missed += (want - found).total()
        more += (found - want).total()
    assert kept > 0.97 * (kept + missed) and kept > 0.97 * (kept + more)


def test_ratios_decide_inside_marks(spark, monkeypatch):
    """Another order of the ratios gives another text, on nearly every page."""
    pages = [r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    before, values = [main_text(p) for p in pages], html_text.line_values
    rng = np.random.default_rng(3)

    def scrambled(lines):
        found, threshold = values(lines)
        return rng.permutation(found), threshold

    monkeypatch.setattr(html_text, "line_values", scrambled)
    changed = sum(main_text(p) != text for p, text in zip(pages, before))
    assert changed > 0.9 * len(pages)


def test_smoothing_is_a_mean():
    assert np.allclose(html_text.smoothed(np.full(7, 3.0)), 3.0)
    assert html_text.smoothed(np.array([0, 0, 9, 0, 0.0])).argmax() == 2


def test_query_against_the_article_element(spark):
    """Brute force for the given pages: the article element without its tags."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    found = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1]
        inside = re.sub(r"</?(p|br|h1)>", " ", inside)
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", inside)).split())
        assert found[r["page_id"]]["text"] == text
        assert found[r["page_id"]]["n_chars"] == len(text)


def test_messy_table(spark):
    rows = [(1, "http://a", None, "x", 5), (1, "http://a", "<p>a", "x", 5),
            (None, None, "<p>b" * 50_000, "x", 5), (2, "", "<div>" * 20_000 + "x", "x", 5)]
    pages = spark.createDataFrame(
        rows, "page_id long, url string, html string, text string, n_chars int")
    found = html_text.extract(pages).collect()
    assert [(r["page_id"], r["n_chars"]) for r in found] == [(1, 0), (1, 1), (None, 99_999), (2, 1)]
    assert html_text.extract(pages.limit(0)).count() == 0
