"""Places where an operator did less than the whole job (review of round 2)."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_ngram_join_id_that_hashes_to_bit_0(spark):
    from tablemove.llm.ngram_join import BITMAP_BITS, jaccard_join
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(25317696, text), (25317697, text + " more"), (25317698, "some thing else")], "doc_id long, text string")
    assert docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)) == 0).count() == 1
    out = {r.doc_id: r.component_id for r in jaccard_join(docs).collect()}
    assert out == {25317696: 25317696, 25317697: 25317696, 25317698: 25317698}


def test_html_names_inside_an_article():
    from tablemove.llm.html_text import extract
    page = ('<body><div id="my-sidebar">off</div><section class="comments">off</section><article><h1>Top</h1><p>one two three</p>'
            '<h2 id="related-work">Related work</h2><p id="search-results">four five six</p><section id="discussion"><p class="notice">seven eight nine</p></section>'
            '<div id="social-history">ten eleven</div><div class="ad">off</div><p>end</p></article></body>')
    assert extract(page, {}) == "Top\none two three\nRelated work\nfour five six\nseven eight nine\nten eleven\nend"


def test_html_skipped_list_does_not_split_an_article():
    from tablemove.llm.html_text import extract
    links = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(300))
    page = f"<article><p>one two three four</p><nav><ul>{links}</ul></nav><p>five six seven eight nine</p></article>"
    assert extract(page, {}) == "one two three four\nfive six seven eight nine"
