"""Main-text extraction: pages whose article is known, plain versions of the decoding and the features, edge rows."""

import html
import itertools
import os
import re

import numpy as np
import pytest

from reelspark.llm import dom, extract
from reelspark.llm.boost import BoostedTrees

from ..conftest import SF01

L = "Of thinger a edering reednt that, and the house was red. Ateaea thedtion stth esan thoreaon thining, thntly to re this."
P = f"<p>{L}</p>"


def article(source):
    """What the test tables' own pages hold between the ``article`` tags."""
    inside = re.search("<article>(.*?)</article>", source, re.S)[1]
    return " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inside))).split())


@pytest.fixture(scope="module")
def trees(spark):
    rows = spark.read.parquet(f"{SF01}/pages.parquet").orderBy("page_id").limit(100).collect()
    return extract.train([r.html for r in rows])


def test_all_pages_of_the_table(spark):
    from reelspark.llm.queries import QUERIES
    want = {r.page_id: (r.url, article(r.html)) for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    got = {r.page_id: (r.url, r.text) for r in QUERIES["op12_boosted_dom"](spark, SF01).collect()}
    assert got == want


CASES = [
    (f"<div id='header'><h1>Site</h1><div class=menu><a href=/a>A</a> <a href=/b>B</a></div></div><div id='content'><h1>Title</h1>{P}{P}</div>"
     "<div id='footer'>Copyright foo</div>", f"Title {L} {L}"),
    (f"<BODY><HEADER><A HREF=x>Home</A></HEADER><MAIN><H2>Title</H2>{P}<P>Short.{P}</MAIN><ASIDE><h3>Related</h3>{P}</ASIDE>"
     f"<section id=comments><h3>2 comments</h3><div class='comment'>{P}</div></section><FOOTER>foo</FOOTER>", f"Title {L} Short. {L}"),
    (f"<article><h1>T</h1>{P}<div class='advert'>{P}</div>{P}<form action=x><label>Mail</label><input name=q> Subscribe</form>{P}</article>"
     f"<div class='comments'>{P}{P}</div>", f"T {L} {L} {L}"),
    (f"<div class='cookie-notice'><p>We use cookies. {L}</p></div><div class='post'><h1>T</h1>{P}{P}</div><div class='sidebar'>{P}</div>", f"T {L} {L}"),
    (f"<h1>T</h1>{P}{P}<p>end</p>", f"T {L} {L} end"),
    (f"<table><tr><td class=menu><a href=a>one</a><br><a href=b>two</a><td class=content><h1>T</h1>{P}{P}<tr><td class=footer>Copyright x</table>", f"T {L} {L}"),
    (f"<article><h1>A&nbsp;&eacute;&#233;&#x27;s</h1><p>x &lt;b&gt; y<br>z&amp;amp;</p><ul><li>one\n\t two</li><li>t<b>hr</b>ee</li></ul>{P}</article>",
     f"A éé's x <b> y z&amp; one two three {L}"),
    (f"<article><h1>T</h1><p>foo <span class='ad'>BUY</span>bar {L}</p><div style='display: none'>{P}</div></article>", f"T foo bar {L}"),
    (f"<head><title>x</title><style>p{{}}</style><script>var t='</p><article>';</script><article><h1>T</h1><!-- <p>no</p> -->{P}<noscript>{P}</noscript></article>",
     f"T {L}"),
    ("<nav><a href=x>x</a></nav><div class=ad>buy this now</div><footer>f</footer>", ""), ("", ""), ("   \n", ""), ("<!-- open", ""), ("<div", ""),
]


@pytest.mark.parametrize("source, want", CASES)
def test_pages_of_other_makes(trees, source, want):
    assert extract.main_texts([source], trees) == [want]


def test_held_out_pages(trees):
    """Pages set by another seed, from words the trees have not seen."""
    setter, right = extract.Setter([], [], 99), 0
    for source in (setter.page() for _ in range(200)):
        page = dom.Pages()
        page.add(source)
        leaf, want = np.array(page.tag) == dom.TEXT, dom.labels(page)
        right += bool((extract.decode(page, trees.raw(dom.features(page))) == want)[leaf].all())
    assert right >= 180


def random_page(rng, n):
    page = dom.Pages()
    page.page.append(0)
    page.node(0, 1, 0)
    parents = [0]
    for k in range(1, n):
        while len(parents) > 1 and rng.random() < 0.5:
            page.last[parents.pop()] = k - 1
        parents.append(page.node(parents[-1], int(rng.integers(0, 4)), 0, "x" * int(rng.integers(0, 5))))
    for k in parents:
        page.last[k] = n - 1
    return page


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9, 9, 9, 10):
        page, odds = random_page(rng, n), rng.normal(0, 2, n)
        gain = lambda c: sum(-np.logaddexp(0, -o if x else o) for x, o in zip(c, odds))
        fits = [c for c in itertools.product((False, True), repeat=n) if all(not c[k] or k == 0 or c[page.parent[k]] for k in range(n))]
        got = extract.decode(page, odds)
        assert tuple(got) in fits and gain(got) == pytest.approx(max(map(gain, fits)))


def test_subtree_features_equal_plain_sums():
    rng = np.random.default_rng(4)
    page = random_page(rng, 40)
    x = dom.features(page)
    below = [[j for j in range(40) if j == k or k in ancestors(page, j)] for k in range(40)]
    col = dom.FEATURES.index
    assert x.shape == (40, len(dom.FEATURES))
    for k in range(40):
        assert np.expm1(x[k, col("nodes")]) == pytest.approx(len(below[k]), rel=1e-4)
        assert np.expm1(x[k, col("chars")]) == pytest.approx(sum(len(page.texts[j]) for j in below[k]), abs=1e-3)
        assert x[k, col("depth")] == len(ancestors(page, k))
        assert x[k, col("siblings")] == (1 if k == 0 else sum(page.parent[j] == page.parent[k] for j in range(1, 40)))


def ancestors(page, k):
    out = []
    while page.parent[k] != k:
        k = page.parent[k]
        out.append(k)
    return out


def test_trees_learn_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = BoostedTrees().fit(x[:1000], y[:1000])
    assert ((model.raw(x[1000:]) > 0) == (y[1000:] > 0)).mean() > 0.95     # 32 bins place a cut to about 0.015
    assert abs(BoostedTrees().fit(np.zeros((10, 2)), np.ones(10)).raw(np.zeros((1, 2)))[0]) > 2      # nothing to split
    assert BoostedTrees().fit(np.zeros((0, 2)), np.zeros(0)).raw(np.zeros((3, 2))).tolist() == [0, 0, 0]


def test_edge_rows(spark):
    long_page = "<body><nav><a href=x>x</a></nav><article><h1>T</h1>" + P * 20_000 + "</article>"
    rows = [(1, None, "a"), (2, "", "b"), (3, CASES[0][0], "c"), (3, CASES[0][0], "c"), (None, CASES[4][0], None), (4, long_page, "d"), (5, "no markup " + L, "e")]
    pages = spark.createDataFrame([(i, h, u, 1) for i, h, u in rows], "page_id long, html string, row string, main_text int").repartition(3)
    out = extract.extract_main_text(pages, set_again=300)
    assert out.columns == ["page_id", "row", "main_text", "main_chars"]
    texts = {"1": "", "2": "", "3": CASES[0][1], "None": CASES[4][1], "4": "T" + f" {L}" * 20_000, "5": "no markup " + L}
    got = sorted((str(r.page_id), str(r.row), r.main_text, r.main_chars) for r in out.collect())
    assert got == sorted((str(i), str(u), texts[str(i)], len(texts[str(i)])) for i, _, u in rows)


def test_empty_table(spark):
    out = extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string"), set_again=50)
    assert out.count() == 0 and out.columns == ["page_id", "url", "main_text", "main_chars"]


def test_the_kernel_needs_no_copy_of_the_package(trees, tmp_path):
    """Workers get the reading, the trees and the decoding by value."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    (tmp_path / "kernel").write_bytes(cloudpickle.dumps(lambda source: extract.main_texts([source], trees)))
    script = "from pyspark import cloudpickle as c; print(c.loads(open('kernel', 'rb').read())('<article class=post><h1>T</h1><p>hello</p></article>'))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=100)
    assert out.stdout.strip() == "['T hello']", out.stderr
