import itertools
import math
import random

from pyspark.sql import functions as F

from threadloom.llm import html_text as H
from threadloom.llm.page_samples import labelled_pages

PAGES = "page_id long, url string, html string"


def test_marginals_match_enumeration():
    rnd, model = random.Random(1), H.trained()
    for _ in range(12):
        tree = H.Tree("<div><p>a</p><ul><li>b<li>c</ul></div><p>d" if rnd.random() < 0.5 else "<article><h1>x</h1><p>y<p>z</article><nav>n</nav>")
        f = tree.features()
        weights = [rnd.uniform(-2, 2) for _ in model.weights]
        edges = [[[rnd.uniform(-2, 2) for _ in "ab"] for _ in "ab"] for _ in model.edges]
        full = H.Model(weights, edges).messages(tree, f)[2]
        kinds, mass = tree.kinds(), [[0.0, 0.0] for _ in tree.parent]
        for y in itertools.product((0, 1), repeat=len(tree.parent)):
            e = sum(sum(weights[i] for i in f[k]) for k in range(len(y)) if y[k]) + sum(edges[kinds[k]][y[tree.parent[k]]][y[k]] for k in range(1, len(y)))
            for k, v in enumerate(y):
                mass[k][v] += math.exp(e)
        for k, (a, b) in enumerate(mass):
            assert abs(full[k] - math.log(b / a)) < 1e-6


def test_held_out_accuracy():
    model, right, total = H.trained(), 0, 0
    for page in labelled_pages(120, 991):
        tree = H.Tree(page)
        y, full = tree.labels(), model.messages(tree)[2]
        total += len(tree.blocks)
        right += sum((full[n] > 0) == (y[n] == 1) for n, _, _ in tree.blocks)
    assert right / total > 0.98


LAYOUT = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a><p>A tagline of it</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<!-- ad <p>hidden</p> --><div class="ad">Buy this now, it is cheap.</div><div class="cookie-notice"><p>We use cookies.</p></div>
<article><h1>A&nbsp;title &amp; more</h1><p>First   paragraph with <b>bold</b>
 text &lt;here&gt;.<p>Second one; it isn&#39;t closed.<ul><li>One item.<li>Two items.</ul><form><label>Mail</label><input><p>Sign up</p></form></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside>
<section id="comments"><h3>Comments</h3><p>I liked this very much. Thank you.</p><p>So did I.</p></section><footer>&copy; 2020 Site &middot; All of it.</footer></body></html>"""


def test_a_page_with_every_kind_of_boilerplate(spark):
    out = H.main_text(spark.createDataFrame([(1, "u", LAYOUT)], PAGES)).first()
    assert out.text == "A title & more\nFirst paragraph with bold text <here>.\nSecond one; it isn't closed.\nOne item.\nTwo items."


def test_articles_of_the_tables_come_out_whole(spark, sf):
    import html
    import re

    for r in H.main_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.split(r"</?(?:p|h1)>", re.sub(r"<b>|</b>|<br>", "", r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]))
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in body) if x)


def test_odd_pages(spark):
    rows = ["", None, "no tags at all", "<p", "<p>a<", "<script>x", "<!-- open", "<article><p>" + "word " * 200_000, "<div>" * 3000 + "deep", "<p class='x'y\"z>q</p>", "</p></div>x", "<textarea><p>in</p></textarea>", "<<<>>>&&&", "<a href=\"unclosed>text"]
    docs = spark.createDataFrame([(k, None, h) for k, h in enumerate(rows)], PAGES).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = {r.page_id: r.text for r in H.main_text(docs).collect()}
    assert len(got) == len(rows) and got[0] == got[1] == got[11] == "" and len(got[7]) == 5 * 200_000 - 1
    twice = docs.where("page_id = 7").union(docs.where("page_id = 7"))
    assert H.main_text(twice).count() == 2 and H.main_text(docs.limit(0)).collect() == []


P = "The town council met on Monday to vote on a new plan. It passed by a narrow margin after a long debate."
Q = "Many residents had come to speak, and most of them were in favour. The mayor thanked them all."
LINKS = "".join(f'<li><a href="/a{k}">Linked story number {k}</a></li>' for k in range(8))
ITEMS = "\n".join(f"Linked story number {k}" for k in range(8))
BAR = "".join(f'<a href="/a{k}">Link {k}</a> ' for k in range(10))
LAYOUTS = {  # written by hand, none from the generator
    f"<html><body><article><h1>T</h1><p>{P}</p><p>The energy is <math><mi>E</mi><mo>=</mo><mn>5</mn><annotation>x</annotation></math> joules.</p></article></body></html>": f"T\n{P}\nThe energy is E=5 joules.",
    f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>T</h1><p>{P}</p><ul>{LINKS}</ul><p>{Q}</p></article><footer>c</footer></body></html>": f"T\n{P}\n{ITEMS}\n{Q}",
    f'<html><body><article><h1>T</h1><p>{P}</p><p>{Q}</p><section class="references"><h2>References</h2><ol><li><a href=x>Smith 2001</a></li><li><a href=y>Jones 2003</a></li></ol></section></article></body></html>': f"T\n{P}\n{Q}\nReferences\nSmith 2001\nJones 2003",
    f"<html><body><div><p>{P}</p><p>{Q}</p></div><div>{BAR}</div></body></html>": f"{P}\n{Q}",
    f"<html><body><div>{BAR}</div><div><h1>T</h1><p>{P}</p><p>{Q}</p><p>{P}</p></div><div>Copyright 2020</div></body></html>": f"T\n{P}\n{Q}\n{P}",
    f"<html><body><article><h1>T</h1><p>{P}</p><p>{Q}</p><div class=related><h3>More</h3><ul>{LINKS}</ul></div></article></body></html>": f"T\n{P}\n{Q}",
    f"<p>{P}</p><p>{Q}</p>": f"{P}\n{Q}",
    P: P,
    f"<html><body><header><h2>Site</h2></header><main><p>{P}</p><blockquote>{Q}</blockquote><table><tr><td>a</td><td>b</td></tr></table></main><aside><p>{P}</p></aside></body></html>": f"{P}\n{Q}\na\nb",
}


def test_layouts_by_hand():
    model = H.trained()
    for page, text in LAYOUTS.items():
        assert model.text(page) == text


def test_stored_weights_are_those_of_training():
    made, stored = H.train(labelled_pages(H.TRAINING_PAGES, H.SEED)), H.trained()
    assert all(abs(a - b) < 1e-3 for a, b in zip(made.weights, stored.weights, strict=True))


def test_deep_pages_and_stray_closers_take_linear_time():
    import time

    began = time.time()
    H.trained().text("<div>" * 60_000 + "</p></span></li></ul><li>" * 60_000 + "x")
    assert time.time() - began < 10
