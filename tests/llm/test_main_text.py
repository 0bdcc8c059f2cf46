import html
import itertools
import random
import re

import pytest

from sparkfold.llm import main_text as m

SCHEMA = "page_id long, url string, html string, text string, n_chars long"


def _page(title, paragraphs, extra="", end="</body></html>"):
    body = "".join(f"<p>{html.escape(p)}</p>" if k % 3 else f"<p><b>{html.escape(p)}<br>" for k, p in enumerate(paragraphs))
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu words</a></li></ul></nav><!-- <p>no</p> -->'
        f'<div class="ad">buy some things here now</div><article><h1>{html.escape(title)}</h1>{body}{extra}</article><footer>&copy; site &middot; words at the end of it all</footer>{end}'
    )


def _rows():
    rng = random.Random(3)
    words = ["stone", "river", "<b>", "a&b", "größe", "中文", "x < y", "end."]
    texts = [[" ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(rng.randint(3, 60))) for _ in range(rng.randint(1, 6))] for _ in range(30)]
    return [(k, ps, _page(ps[0][:30], ps, end="</body></html>" if k % 2 else "")) for k, ps in enumerate(texts)]


def _query(spark, pages, docs, monkeypatch):
    tables = {"pages": spark.createDataFrame(pages, SCHEMA).repartition(2), "documents": spark.createDataFrame(docs, "doc_id long, text string, url string, html string")}
    monkeypatch.setattr(m.common, "table", lambda _s, _d, name: tables[name])
    return [tuple(r) for r in m.op11_main_text(spark, "").collect()]


def test_articles_with_labelled_pages(spark, monkeypatch):
    rows = _rows()
    pages = [(k, f"u{k}", page, "clash", -1) for k, _, page in rows]
    odd = [(900, "n", None, "x", 0), (901, "e", "", "x", 0), (902, None, "<nav><p>only a menu here</p></nav>", "x", 0), (None, "i", rows[0][2], "x", 0), (0, "u0", rows[0][2], "x", 0)]
    docs = [(k, "\n".join(ps), "u", "h") for k, ps, _ in rows] + [(99, None, None, None), (98, "", "", "")]
    got = sorted(_query(spark, pages + odd, docs, monkeypatch), key=repr)
    said = lambda ps: " ".join(" ".join([ps[0][:30], *ps]).split())
    want = [(k, f"u{k}", said(ps)) for k, ps, _ in rows] + [(900, "n", ""), (901, "e", ""), (902, None, ""), (None, "i", said(rows[0][1])), (0, "u0", said(rows[0][1]))]
    assert got == sorted(((*w, len(w[2])) for w in want), key=repr)


def test_empty_tables(spark, monkeypatch):
    assert _query(spark, [], [], monkeypatch) == []
    page = _page("A title", ["Some words that are not a line of any text.", "More of them."])
    assert _query(spark, [(1, "u", page, "", 0)], [], monkeypatch)[0][2] == "A title Some words that are not a line of any text. More of them."


def test_labels_and_weights(spark):
    rows = _rows()
    pages = spark.createDataFrame([(k, page) for k, _, page in rows], "page_id long, html string")
    docs = spark.createDataFrame([("\n".join(ps),) for _, ps, _ in rows], "text string")
    labelled = m.labelled_pages(pages, docs)
    assert len(labelled) == len(rows)
    weights = m.learn(labelled)
    assert all(w >= 0 if kind == "word" else w < 0 for (kind, _), w in weights.items())
    assert weights["word", "p"] == m.MOST_WORD and weights["word", "zone advert"] == 0 and weights["tag", "article"] < -10 < weights["tag", "p"]
    assert len(m.labelled_pages(pages, docs, sample=7)) == 7


def test_region_against_all_parts():
    rng = random.Random(7)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(rng.randint(0, 12))]
        sums = {(i, j): sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2)}
        lo, hi = m.region(scores)
        best = max([0.0, *sums.values()])
        assert (sum(scores[lo:hi]) if hi else 0.0) == best
        if hi:
            assert not any(s == best and (j < hi or j == hi and i > lo) for (i, j), s in sums.items())


def test_an_article_among_everything_else():
    page = (
        "<head><title>T</title><style>p>a{}</style></head><header><h1>Site</h1><p>Welcome to the site with all its news</p></header><div class='cookie-notice'><p>We use cookies to improve things here today</p></div>"
        "<nav><a href=/>Home</a></nav><main><article><h1>Title</h1><p>First <b>pa</b>ra, caf&eacute &lt;3 and a < b of it all.</p><div class='post-ad'><p>Buy this thing now for less</p></div><ul><li>one item<li>two items</ul>"
        "<p>Second&nbsp;para<br>line</p><script>var a='<p>no</p>';</script><form><p>Sign up here now please</p></form><blockquote>Quoted words</blockquote><p>See <a href='x>y'>this link</a>.</p></article>"
        "<section id=comments><h2>Comments</h2><p>I liked this article very much indeed thanks</p></section></main><aside><p>Related words words words words</p></aside><footer><p>all rights reserved</p></footer>"
    )
    assert m.main_text(page, {}) == "Title First para, café <3 and a < b of it all. one item two items Second para line Quoted words See this link."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("plain words", "plain words"), ("<p>a<p>b", "a b"), ("x<!-- y", "x"), ("x <script>y", "x"), ("x <p cla", "x"), ("a<b>b</b>c<br>d", "abc d"), ("1 < 2 &amp 3", "1 < 2 & 3"), ("</p></b>x", "x"), ('<p title="a>b">x y', "x y"),
        ('<div class="ad">left open<article><p>Hi there you</p></article>', "Hi there you"), ("<P>Up<SCRIPT>no</SCRIPT>per</P>", "Upper"), ("<div>" * 50, ""),
    ],
)
def test_odd_markup(page, text):
    assert m.main_text(page, {}) == text


def test_a_very_long_page():
    ps = [f"word{k} and more" for k in range(60_000)]
    assert m.main_text(_page("Long", ps), {}) == " ".join(["Long", *ps])
    assert re.fullmatch(r"x( x)*", m.main_text("<p>x" * 100_000, {}))
