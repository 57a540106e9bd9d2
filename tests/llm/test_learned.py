"""Language id, quality and main-text extraction: held-out accuracy and defined edge results."""

import re
import time
import zlib

import numpy as np
import pytest

from feedlens.llm import extraction, language, quality
from feedlens.llm.dom import Page, blocks
from feedlens.llm.sample_pages import labelled_page

from ..conftest import SF_MID
from .conftest import CLASHING


def _out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = docs.select("doc_id", "lang").collect()
    got = {r.doc_id: r for r in language.identify_language(docs).collect()}
    held = [r for r in rows if _out(r.doc_id)]
    assert all(got[r.doc_id].held_out == _out(r.doc_id) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.98


def test_language_ignores_its_labels_when_predicting(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").limit(300)
    names, proto = language.learn_prototypes(docs, "text", "lang", "doc_id")
    assert names == sorted(names) and proto.shape == (len(names), language.DIMENSIONS)
    a, b = language.bundle(["Le texte, LE TEXTE!", "le texte le texte"]), language.bundle(["xyz"])
    assert np.allclose(a[0], a[1], atol=1e-5) and abs(float(a[0] @ b[0])) < 0.3


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "fr"), (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"),
            (6, "the cat", None), (None, "le chat", "fr"), (4, "the cat and the dog", "en"), (7, "日本語 текст", "xx"), (8, "the " * 50_000, None)]
    extra = ", ".join(f"`{c}` long" for c in CLASHING)
    df = spark.createDataFrame([(*r, *[1] * len(CLASHING)) for r in rows], f"doc_id long, text string, lang string, {extra}")
    got = {r.doc_id: r for r in language.identify_language(df).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[6].lang_pred == "en" and got[8].lang_pred == "en"
    assert language.identify_language(df.limit(0)).count() == 0
    alone = language.identify_language(df.where("lang IS NULL")).collect()
    assert {r.lang_pred for r in alone} == {"und"}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF_MID}/documents.parquet"), spark.read.parquet(f"{SF_MID}/labels.parquet")


def test_quality_accuracy(tables):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    held = [i for i in truth if _out(i)]
    assert all(g.predicted == int(g.score >= 0.3) and 0 <= g.score <= 1 and g.held_out == _out(g.doc_id) for g in got.values())
    good = [got[i].score for i in held if truth[i]]
    bad = [got[i].score for i in held if not truth[i]]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95


def test_quality_filter_agrees_with_the_scores(tables):
    docs, labels = tables
    want = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted}
    kept = quality.keep_quality(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.select("doc_id").collect()} == want


def test_forest_matches_a_walk_through_its_trees():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)
    for k in range(0, 400, 37):
        total = forest.start
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            for level in range(3):
                at = (1 << level) - 1 + node
                node = 2 * node + int(x[k, f[at]] > c[at])
            total += leaf[node]
        assert abs(total - forest.margin(x[k:k + 1])[0]) < 1e-9
    assert np.mean((forest.score(x) > 0.5) == y) > 0.95


def test_statistics_of_one_text():
    x = dict(zip(quality.FEATURES, quality.statistics(__import__("pyarrow").array(["Ab ab cd\ncd !! é"]))[0].tolist()))
    assert x["log_words"] == pytest.approx(np.log1p(6)) and x["distinct_words"] == pytest.approx(4 / 6)
    assert x["same_as_before"] == pytest.approx(2 / 6) and x["upper"] == pytest.approx(1 / 17) and x["wide"] == pytest.approx(2 / 17)
    assert x["byte_33"] == pytest.approx(2 / 17) and x["lone_letters"] == 0


def test_quality_edges(spark):
    extra = ", ".join(f"`{c}` long" for c in CLASHING)
    df = spark.createDataFrame([(i, t, *[i] * len(CLASHING)) for i, t in [(1, None), (2, ""), (3, "x" * 300_000), (None, "a b"), (4, "a"), (4, "a")]],
                               f"doc_id long, text string, {extra}")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(df, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, None), (4, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    assert quality.score_quality(df, some).count() == 6
    assert quality.score_quality(df.limit(0), some).count() == 0
    assert quality.keep_quality(df, none).count() == 6


def _main(page):
    p = Page(page)
    ok = [re.search(r"(?<![\w-])data-main(?![\w-])", a) is not None for a in p.attrs]
    return blocks([(b, t) for e, b, t in p.texts if ok[e]])


def test_extraction_on_unseen_pages():
    pages = [labelled_page(50_000 + k) for k in range(300)]
    got = extraction.extract(pages, extraction.default_potentials())
    assert np.mean([g == _main(p) for g, p in zip(got, pages)]) > 0.97


def test_marginals_against_enumeration():
    r = np.random.default_rng(3)
    f = extraction.Forest([Page("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><p>d</p>")])
    w = extraction.Potentials(r.normal(size=extraction.FEATURES), r.normal(size=(extraction._N_TAGS, 2, 2)))
    odds = np.bincount(f.row, w.unary[f.col], f.n)
    total, on = 0.0, np.zeros(f.n)
    for k in range(1 << f.n):
        state = (k >> np.arange(f.n)) & 1
        e = np.exp((odds * state).sum() + sum(w.pair[f.tag[c], state[f.parent[c]], state[c]] for c in range(1, f.n)))
        total += e
        on += e * state
    assert np.allclose(extraction.marginals(f, w)[0], on / total)


def test_extraction_on_the_table(spark):
    """The table's pages keep their article in one element; it must come out whole and alone."""
    import html as h
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet")
    got = {r.page_id: r for r in extraction.extract_main_text(pages).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        lines = [re.sub(r"[\x20\x09-\x0D]+", " ", h.unescape(re.sub("</?b>", "", x))).strip(" ") for x in re.split("</?(?:p|h1|br)>", body)]
        want = "\n".join(x for x in lines if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_reader_is_forgiving():
    p = Page("a<p>b<p>c<div>d</p>e</div><ul><li>x<li>y</ul>&lt;i&gt;&#65;<script>if (a<b) '</p>'</script><!-- <p>no --><br/>z <b q='>'>w< 3")
    assert blocks([(b, t) for _, b, t in p.texts]) == "a\nb\nc\nd\ne\nx\ny\n<i>A\nz w< 3"
    assert Page("").tag == ["#root"] and Page("<<<>>").texts
    for page in ("<div" * 50, "<p>" * 3000, "<!--", "<script>", "</x></y>", "<a href='", "\0<\x01>", "&#xFFFFFFFF;&nope;"):
        extraction.extract([page], extraction.default_potentials())


def test_extraction_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a href=x>menu</a></nav>"), (None, "u", "<article><p>" + "word " * 20_000 + "</p></article>"), (3, "u", "no markup")]
    extra = ", ".join(f"`{c}` long" for c in CLASHING)
    df = spark.createDataFrame([(*r, *[1] * len(CLASHING)) for r in rows], f"page_id long, url string, html string, {extra}")
    got = extraction.extract_main_text(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 5 and by[1].text == "" and by[2].text == "" and by[2].url is None and by[1].n_chars == 0
    assert by[None].n_chars == 5 * 20_000 - 1
    assert extraction.extract_main_text(df.limit(0)).count() == 0


def test_reader_is_linear():
    """Hundreds of kilobytes of unclosed or unmatched tags are read in about the time of their tokens."""
    start = time.perf_counter()
    for html in ("<div>" * 150_000, "<b>" * 150_000 + "</i>" * 150_000, "<p><li>" * 80_000, "<b><i></b>" * 80_000, "<td><p>" * 80_000):
        page = Page(html + "text")
        assert page.texts[-1][2] == "text"
    assert time.perf_counter() - start < 20


def test_languages_of_repeated_ids(spark):
    rows = [(1, "le chat et le chien dans la maison", "fr")] * 3000 + [(10 + i, "the cat and the dog in the house", "en") for i in range(50)]
    rows = [(None if out else i, t, lang) for i, t, lang in rows for out in [False]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, _ = language.learn_prototypes(df, "text", "lang", "doc_id", docs_per_language=20)
    assert names == ["en", "fr"]
    assert language.learn_prototypes(df, "text", "lang", "doc_id", docs_per_language=20, most_languages=1)[0] == ["en"]
    got = language.identify_language(df).where("doc_id = 1").select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in got] == ["fr"]


def test_quality_of_repeated_rows(spark):
    """One labelled id with thousands of rows brings no more than the sample to the driver."""
    rows = [(1, f"good words number {i}") for i in range(3000)] + [(2, "bad! bad! " * 5), (3, "fine words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.fit

    def spy(x, y, *rest):
        seen.append(len(x))
        return fit(x, y, *rest)

    quality.fit = spy
    try:
        assert quality.score_quality(df, labels, sample_docs=100).count() == len(rows)
    finally:
        quality.fit = fit
    assert seen == [100]
