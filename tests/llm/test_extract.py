import html as entities
import itertools
import random
import re
import time

import pytest

from creditloom.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>Site | Title</title><style>p{x:y}</style><script>var t="</p><p>no";</script></head>
<body><header><h1>My Site</h1><p>Welcome to this site of ours.</p></header>
<div id="cookie-notice"><p>We use cookies to make this page better for you and everyone else.</p></div>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News &amp; more</a></ul></nav>
<div class="ad">Buy these great things now, they are really very cheap today.</div>
%s
<aside><p>Other things that you may want to read on this site today.</p></aside>
<section class="comments"><h3>2 comments</h3><p>I really liked this piece, thank you for writing it.</p></section>
<form><label>Your mail address</label><input name=q></form><footer>&copy; 2024 Us. All rights reserved.</footer></body></html>"""


@pytest.mark.parametrize("box", ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', "<div>%s</div>"])
def test_article_alone(box):
    body = (
        "<h1>The &lt;title&gt;</h1><p>First  paragraph\nhas <b>bold</b> and <a href='x'>linked</a> words, and goes on a bit.<p>Second&nbsp;one<br>"
        "continues &eacute;ven here, with a few more words to it.<ul><li>An item of the list in it.</ul><!-- no <p>comment</p> -->"
        "<p>And a last sentence ends the whole text of this page."
    )
    want = (
        "The <title>\n\nFirst paragraph has bold and linked words, and goes on a bit.\n\nSecond one continues éven here, with a few more words to it."
        "\n\nAn item of the list in it.\n\nAnd a last sentence ends the whole text of this page."
    )
    assert extract.main_text(PAGE % (box % body)) == want


def test_test_pages(spark):
    """The test pages wrap their text in an article; a plain reading of that must agree."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        want = "\n\n".join(t for t in (" ".join(entities.unescape(x).split()) for x in parts) if t)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    costs = [rng.uniform(-1, 1) for _ in range(n)]
    edges = {(i, j): rng.uniform(0, 0.6) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

    def cost(label):
        own = sum(c if c > 0 and not x else -c if c < 0 and x else 0 for c, x in zip(costs, label))
        return own + sum(w for (i, j), w in edges.items() if label[i] != label[j])

    least = min(map(cost, itertools.product([False, True], repeat=n)))
    assert abs(cost(extract.minimum_cut(costs, edges)) - least) < 1e-9


def test_smoothness_turns_a_weak_block():
    assert extract.minimum_cut([2, -0.3, 2], {(0, 1): 0.4, (1, 2): 0.4}) == [True, True, True]
    assert extract.minimum_cut([-2, 0.3, -2], {(0, 1): 0.4, (1, 2): 0.4}) == [False, False, False]


def test_odd_pages(spark):
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "plain text without any markup, but a few words."), (4, "u", "<p>cut <a href='x"), (5, "u", "<<<>>> < 3"),
        (5, "u", "<article><p>Twice.</article>"), (5, "u", "<article><p>Twice.</article>"), (None, "u", "</p></div><nav>x</nav>"),
        (7, "u", "<article>" + "<p>Word and word again.</p>" * 20000), (8, "u", "<div>" * 5000 + "deep"), (9, "u", "<script>x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = extract.extract(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[9] == "" and by_id[5] == "Twice." and by_id[7].count("\n\n") == 19_999
    assert by_id[3].startswith("plain text")
    assert extract.extract(pages.where("false")).count() == 0


def test_siblings_turn_short_paragraphs():
    """Without article or main, short lines look like boilerplate by themselves; their siblings say that they are not."""
    lines = ["A first paragraph of some length, which ends in a full stop.", "Short line", "Another paragraph of the same kind, with its own stop."]
    page = PAGE % ("<div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>")
    found = extract.blocks(page)
    costs = [b.log_odds() for b in found]
    labels = extract.minimum_cut(costs, extract.smoothness(found))
    assert [b.text for b, c, x in zip(found, costs, labels) if (c > 0) != x] == ["Short line"]
    assert extract.main_text(page) == "\n\n".join(lines)


def test_pages_without_article(spark):
    """The test pages with other elements in place of article and main: the cut finds more of them than costs alone, and all
    but a few."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    right = alone = 0
    for page in pages:
        found = extract.blocks(re.sub(r"(</?)(?:article|main)\b", r"\1div", page))
        costs = [b.log_odds() for b in found]
        labels = extract.minimum_cut(costs, extract.smoothness(found))
        want = extract.main_text(page)
        right += want == "\n\n".join(b.text for b, keep in zip(found, labels) if keep)
        alone += want == "\n\n".join(b.text for b, c in zip(found, costs) if c > 0)
    assert right > alone and right >= 0.98 * len(pages)


@pytest.mark.parametrize("piece", ['<a "x ', '<a x=">" ', '<a x="', "<div>x ", "<b></i>", "</ x", "<p>A short line</p><p>A longer one has words and a stop.</p>"])
def test_time_grows_with_length(piece):
    """Half a megabyte of markup that never closes; a scan that tried places again would take minutes."""
    began = time.process_time()
    extract.main_text(piece * (500_000 // len(piece)))
    assert time.process_time() - began < 20


def test_broken_tags():
    assert extract.main_text("<article><p>One two.</p><p title='x>Three four.</p><p>Five six.</p></article>") == "One two.\n\nThree four.\n\nFive six."
    assert extract.main_text('<article><p title="a > b">One two.</p></ no><p>Three.<a href="x') == "One two.\n\nThree."
