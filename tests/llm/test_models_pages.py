"""Language identification and page text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import langid
from quarrystone.llm.html import extract_pages, render, with_text

FOLDER = "/root/testdata/sf0.01"


def test_gradients_are_those_of_the_loss():
    net = langid.Network.new(["a", "b", "c"], 3, 2)
    for w in (net.inputs, net.loops):
        w[:] = [x.astype(np.float64) for x in w]
    data = np.random.default_rng(0).integers(0, 256, (langid.CHUNK, 5)).astype(np.uint8)
    truth, mask = np.array([0, 1, 2, 1, 0]), langid.filled(np.array([64, 30, 64, 10, 64]))

    def loss():
        return -(np.log(net.probabilities(net.states(data))[:, truth, np.arange(5)]) * mask).sum() / mask.sum()

    for w, g in zip(net.weights(), net.gradients(data, truth, mask)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, ends = w[at], []
        for step in (1e-2, -1e-2):
            w[at] = old + step
            ends.append(loss())
        w[at] = old
        assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=0.02)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 !? 34", None, None, None), (None, "the and of", None, None, 1), (10**6 + 2, "", "de", "s", 0)], docs.schema)
    found = langid.identify(docs.unionByName(extra).withColumns({"p": F.lit(1), "rank": F.lit(2)})).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    test = [r for r in found if r.held_out and r.lang]
    assert len(test) > 150 and sum(r.lang == r.lang_pred for r in test) > 0.97 * len(test)
    odd = {r.doc_id: r.lang_pred for r in found if r.lang is None}
    assert odd == {10**6: "und", 10**6 + 1: "und", None: odd[None], 10**6 + 2: "und"} and odd[None] != "und"
    assert all(0 <= r.score <= 1 for r in found)
    unlabelled = docs.limit(5).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).collect() == []


def test_every_byte_counts():
    net = langid.Network.new(["a", "b"], 4, 1)
    text = b"some words " * 400
    data, sizes = langid.chunked([text])
    p = net.probabilities(net.states(data))
    want = (p * langid.filled(sizes)[:, None]).sum((0, 2)) / len(text)
    assert langid.label(net, [b"x", text])[1] == pytest.approx(want, rel=1e-4)


CASES = {
    "<p>One <b>bo</b>ld<p>Two<br>line": "One bold\n\nTwo\nline",
    "<ul><li>a<li>b<ol start=4><li>c<li>d</ol></ul>x": "- a\n- b\n  4. c\n  5. d\n\nx",
    "<table><tr><th>Name<th>n<tr><td>Pear<td>3<tr><td colspan=2>all of it</table>": "Name  n\nPear  3\nall of it",
    "<div>a</div><div hidden>b</div><div style='display: none'>c</div><span style='visibility:hidden'>d<i style='visibility:visible'>e</i></span>": "a\ne",
    "<style>.x, p.y {display:none}</style><p class='x z'>no</p><p class=y>no</p><b class=y>yes</b>": "yes",
    "<script>if (a < b) '</p>'</script>t &amp; u &lt;v&gt; 1 < 2": "t & u <v> 1 < 2",
    "<pre>a\n  b\n\nc</pre>d": "a\n  b\n\nc\n\nd",
    "<details><summary>s</summary>t</details><details open><summary>u</summary>v</details>": "s\nu\nv",
    "<!-- x <p>no</p> --><title>no</title>a<!-- open": "a",
    "": "", "   ": "", "<p></p>": "", "a &nbsp; b": "a   b", "<input type=submit value=Go><input value=no>": "Go",
    "x<table><tr><td><table><tr><td>in<td>side</table><td>out</table>": "x\n\nin side  out",
}


@pytest.mark.parametrize("page", CASES)
def test_pages(page):
    assert render(page) == CASES[page]


def test_odd_pages_end():
    for page in ("<div>" * 20000 + "x", "<li>" * 5000, "<ul><li>" * 3000 + "deep", "<table>" * 500 + "<td>x", '<a href="' * 2000, "<" * 5000, "</p>" * 5000, "<p " * 3000 + ">x"):
        assert isinstance(render(page), str)
    assert render("<div>" * 20000 + "x") == "x"


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "u", "")], "page_id bigint, url string, html string").withColumn("text", F.lit("z"))
    assert sorted(map(str, extract_pages(pages).collect())) == sorted(["Row(page_id=1, text='a')"] * 2 + ["Row(page_id=None, text=None)", "Row(page_id=2, text='')"])
    assert with_text(pages).columns == [*pages.columns, "text_"]
    real = extract_pages(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()
    assert len(real) == 250 and all(r.text and "<p>" not in r.text and "track(" not in r.text for r in real)
