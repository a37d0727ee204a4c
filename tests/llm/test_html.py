import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import html_text as H
from orrery.llm import queries


def table(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in rows], "page_id bigint, url string, html string")


def test_unseen_lessons():
    rnd = random.Random(991)
    made = [H.lesson(rnd) for _ in range(200)]
    got = H.extract_pages([p for p, _ in made], H.train())
    assert sum(a == b for a, (_, b) in zip(got, made, strict=True)) >= 190


def test_gradients():
    rng = np.random.default_rng(0)
    d = H.PATH_DIM + H.WORD_DIM + H.MEASURES
    m = H.Labeller([rng.standard_normal((d + H.HIDDEN + 1, 4 * H.HIDDEN)) * 0.2 for _ in range(2)], rng.standard_normal(2 * H.HIDDEN + 1))
    x, mask = rng.standard_normal((2, 4, d)), np.array([[1.0, 1, 1, 1], [1, 1, 0, 0]])
    y = np.array([[1.0, 0, 1, 0], [0, 1, 0, 0]])
    x[1, 2:] = 0
    # The state is kept in single precision, hence the wide step and tolerance.
    _, grads = H._train_step(m, x, mask, y)
    for a, g in zip((*m.w, m.out), grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in a.shape)
            old = a[at]
            a[at] = old + 1e-2
            up = H._train_step(m, x, mask, y)[0]
            a[at] = old - 1e-2
            down = H._train_step(m, x, mask, y)[0]
            a[at] = old
            assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>My Site</h1></header><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A  title &amp; more</h1><p>First <b>bo</b>ld<br>line&nbsp;&#233; &lt;tag&gt; x < y.<p>Second\n\tone of the paragraphs in the text.<ul><li>item a<li>item b</ul><!-- no --><script>x()</script></article>
<div class="comments"><p>What a bad article, said a reader.</p></div><form><label>Mail</label><input></form><div class="ad">Buy now and pay later!</div><footer>&copy; example</footer></body></html>"""
WANT = "A title & more First bold line é <tag> x < y. Second one of the paragraphs in the text. item a item b"


def test_page_and_edges(spark):
    long = "<article>" + "".join(f"<p>Sentence number {i} of a very long page.</p>" for i in range(20_000)) + "</article><footer>end of it</footer>"
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<article><p>unclosed <b>text"), (5, "</div></p>"), (6, "<script>only()"), (7, long), (1, PAGE)]
    df = table(spark, rows).withColumn("row", F.lit(1)).withColumn("main_text", F.lit("old"))
    out = H.extract(df)
    assert sorted(out.columns) == ["main_text", "page_id", "row", "url"]
    got = {r["page_id"]: r["main_text"] for r in out.collect()}
    assert out.count() == len(rows) and got[1] == WANT and got[2] == got[3] == got[5] == got[6] == "" and got[4] == "unclosed text"
    assert got[7] == " ".join(f"Sentence number {i} of a very long page." for i in range(20_000))
    assert H.extract(table(spark, [])).count() == 0


def test_whole_table(spark):
    """The pages' article element, by a plain reading of the markup."""
    d = "/root/testdata/sf0.01"
    wrong = 0
    got = {r["page_id"]: r for r in queries.op7_html_text(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    for r in pages:
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        inner = re.sub(r"</?b>", "", inner)
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
        g = got[r["page_id"]]
        wrong += g["text"] != want
        assert g["n_chars"] == len(g["text"]) and g["url"] == r["url"]
    assert len(got) == len(pages) and wrong == 0


@pytest.mark.parametrize(
    "page,texts",
    [
        ("<script>for(i=0;i<n;i++){x()}</script><article><p>A b</p></article>", ["A b"]),
        ("<script>if(a<b){c()}</script><p>x", ["x"]),
        ("<script>var s='<!-- ', t = \"it's\"</script><p>x</p>", ["x"]),
        ("<style>p>a{content:\"</p>\"}</style><p>y", ["y"]),
        ("<p>a < b and c<br>d<!-->e<!-- <p>x --> f</p>", ["a < b and c de f"]),
        ("<p>1<math><mi>x</mi><mo>=</mo></math> <object>o</object><canvas>c</canvas></p><noscript>n</noscript>", ["1x= oc", "n"]),
        ("<svg><title>t</title><path d='M0'/><text>lab</text></svg><p>k<select><option>q</select> z", ["lab", "k", "z"]),
        ("<p>one <title>abc<p>k", ["one abc", "k"]),
        ("<p title=it's>it's</p><p title='a>b'>b", ["it's", "b"]),
        ("<p>x</p><template><p>t</p></template><textarea><p>f</textarea><p>y", ["x", "y"]),
        ("<p>a<b", ["a"]),
        ("<p>a</p>" + '<a "' * 5 + "<p>b</p>c", ["a", "b", "c"]),
    ],
)
def test_markup(page, texts):
    got = [b[1] for b in H.blocks(page)]
    assert got == texts


@pytest.mark.parametrize("unit", ['<a "', '<a ="', "<a =\"><a ='", "<title>", "<![CDATA[", "<div>a", "<a><hr>", "<a><div>", "<script", "<svg><title>", "<", "</p><select>", "<ul><li>"])
def test_linear_time(unit):
    """A megabyte of unclosed pieces; a quadratic scan would take minutes."""
    began = time.process_time()
    H.blocks("<article><p>text</p>" + unit * (1_000_000 // len(unit)) + "<p>end</p>")
    assert time.process_time() - began < 30
