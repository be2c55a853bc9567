"""Trained models on held-out cases, nearest neighbours against brute force, the pipeline, and odd cases."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import ann, gbt, html_text, langid, q_vectors
from tidewake.llm.common import table

SF = "/root/testdata/sf0.001"


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = gbt.fit(x[:2000], y[:2000], np.ones(2000))
    assert ((trees.margin(x[2000:]) > 0) == (y[2000:] > 0.5)).mean() > 0.95


@pytest.fixture(scope="module")
def trees():
    return html_text.fit(["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"] * 3, pages=500)


def main_text(trees, source):
    page = html_text.Page(source)
    return page.kept_text(page.decode(trees.margin(page.features())))


def test_held_out_layouts(trees):
    rng, words = np.random.default_rng(77), [f"word{k}" for k in range(400)]
    hit = wrong = missed = 0
    for _ in range(150):
        page = html_text.Page(html_text.training_page(rng, words))
        label = np.zeros(len(page.tag), bool)
        label[[0, *page.labels]] = True
        chosen, size = page.decode(trees.margin(page.features())), np.array(page.sizes)
        assert all(chosen[p] for k, p in enumerate(page.parent) if k and chosen[k])  # nothing is kept below a dropped block
        hit, wrong, missed = hit + size[chosen & label].sum(), wrong + size[chosen & ~label].sum(), missed + size[~chosen & label].sum()
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_a_page_with_everything(trees):
    story = ["First paragraph of the story is long enough &amp; more words follow here.", "Second one, equally &eacute;tonnant, with several\n words   in it."]
    source = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body><script>var t="</p>";</script><div id="cookie-notice">We use cookies, accept</div>
        <header class="site-header"><a href="/">Brand</a><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
        <main><article><h1>Big news today</h1><p>{story[0]}<p>{story[1]}<!-- <p>hidden</p> --><div class="ad">Buy this now</div></article><aside class=sidebar><p>Related reading for you</p></aside></main>
        <section class="comments"><h3>Comments</h3><div class="comment"><p>I think this story is far too long, says a reader.</p></div></section>
        <form class="newsletter"><label>Mail</label><p>Subscribe now</p></form><footer>&copy; 2020 Brand</footer></body></html>"""
    assert main_text(trees, source) == "Big news today First paragraph of the story is long enough & more words follow here. Second one, equally étonnant, with several words in it."


@pytest.mark.parametrize("part", [*(f"<{n}>" for n in sorted(html_text.HIDDEN)), "<select><p>x", "<svg ", "<a ", '<a "x>" ', "<head ", "</head", "<svg/>", "<svg></svg></svg>", "<p class='x"])
@pytest.mark.parametrize("tail", ["", '"'])
def test_a_megabyte_of_one_tag_is_read_soon(part, tail):
    began = time.process_time()
    html_text.Page(part * (1_000_000 // len(part)) + tail)
    assert time.process_time() - began < 15


def skipped(source, name, pos):
    """The end of a hidden element by counting its tags from its own on, or -1."""
    depth = 1
    for m in re.compile(rf"<(/?){name}\b[^>]*>", re.I).finditer(source, pos):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if depth == 0:
            return m.end()
    return -1


def test_ends_of_hidden_elements_equal_counting():
    rng = random.Random(4)
    for _ in range(300):
        source = "".join(rng.choice(["<svg>", "</svg>", "<SVG a=1>", "<svg/>", "<p>", "x", "</svg >"]) for _ in range(rng.randrange(30)))
        nested = html_text.Nested(source, "svg")
        for m in re.finditer("<svg[^>/]*>", source, re.I):
            assert nested.end(m.end()) == skipped(source, "svg", m.end())


#: Pages of other make than the training layouts, with the text that a reader would call the article.
OTHER_MAKE = [
    ("<html><body><table><tr><td><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Shop</a></td></tr><tr><td><font><p>The harbour opened at dawn, and the first boats left for the banks before seven in the morning.<p>By noon most of them had come back with full holds.</font></td></tr><tr><td>Copyright 1999 <a href=/m>Mail us</a></td></tr></table></body></html>", "The harbour opened at dawn, and the first boats left for the banks before seven in the morning. By noon most of them had come back with full holds."),
    ("<body><div id=wrap><ul class=menu><li><a href=1>One</a><li><a href=2>Two</a></ul><div class=post><h2>A walk in the hills</h2><p>We set out early and met nobody until the pass, where two shepherds sat by a fire.</p><blockquote>It will rain, said one of them, and it did rain all day long.</blockquote><p>We came home wet but happy with what we had seen.</p></div><div class=share><a href=x>Share</a> <a href=y>Like</a></div></div></body>", "A walk in the hills We set out early and met nobody until the pass, where two shepherds sat by a fire. It will rain, said one of them, and it did rain all day long. We came home wet but happy with what we had seen."),
    (f'<body><nav><a href=/>Home</a> <a href=/b>About</a></nav><div class="related-text"><h1>New bridge</h1>{"<p>The council met on Tuesday to discuss the new bridge, and after three hours it agreed to build it next year.</p> " * 6}</div><footer>Copyright</footer></body>', "New bridge" + " The council met on Tuesday to discuss the new bridge, and after three hours it agreed to build it next year." * 6),
]


@pytest.mark.parametrize("source,text", OTHER_MAKE)
def test_pages_of_other_make(trees, source, text):
    assert main_text(trees, source) == text


def test_odd_pages(spark, trees):
    rows = [(1, None), (2, ""), (3, "<div>" * 3000 + "deep" + "</div>" * 10), (4, "</p></div></nowhere>"), (5, "<p"), (6, "a < b <3"), (7, "<article><p>" + "Kept words are many here. " * 20), (8, "<script>never ends"), (9, '<p class="x>y">quoted attribute text goes on for quite some time here.</p>')]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").selectExpr("*", "'t' AS text", "1 AS key")
    got = {r.page_id: r.text for r in html_text.extract(pages, trees).collect()}
    assert len(got) == 9 and got[1] == got[2] == got[4] == "" and got[7] == ("Kept words are many here. " * 20).strip() and "never" not in got[8]
    assert html_text.extract(pages.filter("false"), trees).count() == 0
    assert html_text.fitted(pages.filter("false")).leaf.shape[0] > 0


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    net = langid.fitted(docs)
    got = langid.identify(docs, net).join(docs.select("doc_id", "lang", langid.held_out().alias("out")), "doc_id").filter("out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_have_no_language(spark, odd):
    net = langid.train([("aa", b"aaaa bbb aab " * 9), ("zz", b"zzz yyy zyz " * 9)] * 20, epochs=3)
    got = {(r.doc_id): (r.lang_pred, r.score) for r in langid.identify(odd, net).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5] == got[6] and got[7][0] in ("aa", "zz")
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.fitted(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    kept = langid.accepted(odd, net, 0.0)
    assert kept.columns == odd.columns and kept.filter("lang is null").count() == 0 and kept.count() == odd.count() - 3
    digits = spark.createDataFrame([(1, "123 456 !!", None)], "doc_id bigint, text string, lang string")
    assert langid.identify(digits, net).first().lang_pred == "und"


def test_no_labelled_language_is_lost(spark):
    """A language with one text, in thousands of copies, and one with a single row are learned beside a large one."""
    docs = spark.createDataFrame([(k, "le chat est assis sur la table rouge " * 5, "fr") for k in range(3000)] + [(5000 + k, f"the dog number {k} runs over the green hill", "en") for k in range(3000)] + [(9000, "der hund schläft unter dem großen baum " * 5, "de")], "doc_id bigint, text string, lang string").repartition(4)
    found = langid.sample(docs, F.lit(True))
    assert {k for k, _ in found} == {"fr", "en", "de"}
    got = langid.identify(docs, langid.train(found)).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang <> 'de' and lang <> lang_pred").count() == 0


def test_scores_equal_a_plain_forward_pass(spark):
    """Each window by loops over filters and places, and the mean by bytes."""
    docs = table(spark, SF, "documents").limit(12)
    net = langid.fitted(table(spark, SF, "documents"))

    def windows(raw):
        for a in range(0, len(raw), langid.WINDOW):
            piece = raw[a : a + langid.WINDOW]
            x = net.vectors[np.array([*piece, *[256] * (langid.WINDOW - len(piece))])]
            tops = [max(0.0, max(float(x[i : i + w].ravel() @ f[:, j]) for i in range(langid.WINDOW - w + 1)) + float(b[j])) for w, f, b in zip(langid.WIDTHS, net.filters, net.bias) for j in range(f.shape[1])]
            z = np.array(tops) @ net.weights + net.offset
            p = np.exp(z - z.max())
            yield len(piece), p / p.sum()

    texts = {r.doc_id: r.text for r in docs.collect() if r.text and len(r.text) < 1500}
    got = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    for d, text in texts.items():
        if got[d].lang_pred != "und":
            each = list(windows(text.encode()))
            p = sum(n * x for n, x in each) / sum(n for n, _ in each)
            assert got[d].lang_pred == net.languages[int(p.argmax())] and abs(got[d].score - p.max()) < 1e-4


def brute(ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        c = u @ u[q]
        other = np.flatnonzero(ids != ids[q])
        order = other[np.lexsort((ids[other], -c[other]))][:k]
        out[int(ids[q])] = [(int(ids[j]), float(c[j])) for j in order]
    return out


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, scale):
    rows = table(spark, f"/root/testdata/{scale}", "embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, np.flatnonzero(ids % 50 == 0))
    got: dict[int, list] = {}
    for r in q_vectors.op8_multiprobe(spark, f"/root/testdata/{scale}").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert np.mean([len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) / len(w) for q, w in want.items()]) >= 0.9
    place = {int(i): k for k, i in enumerate(ids)}
    for q, found in got.items():
        for v, s in found:
            a, b = x[place[q]], x[place[v]]
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_recall_where_most_queries_have_near_copies(spark):
    """Nine tenths of the vectors in groups of near copies, the others without any: both kinds keep their recall."""
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(90, 32))
    x = np.concatenate([np.repeat(heads, 30, axis=0) + rng.normal(scale=0.01, size=(2700, 32)), rng.normal(size=(300, 32))])
    x = x[rng.permutation(len(x))]
    ids = np.arange(len(x))
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    got: dict[int, set] = {}
    for r in ann.nearest(rows, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(ids, x, np.flatnonzero(ids % 50 == 0))
    alone = [q for q, w in want.items() if w[-1][1] < 0.9]
    recall = {q: len(got[q] & {v for v, _ in w}) / 5 for q, w in want.items()}
    assert alone and np.mean([recall[q] for q in alone]) >= 0.9 and np.mean(list(recall.values())) >= 0.9


def test_very_large_and_small_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [3e-320, 3e-320]), (3, [1.5e308, -1.5e308]), (4, [1.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 4, 3] and all(abs(r.score - 1) < 1e-12 for r in got[:3]) and abs(got[3].score) < 1e-12


def test_odd_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "SUCCESS", 0.999)
    nan = float("nan")
    rows = [(0, [1.0, 0.0, 0.0]), *[(k, [2.0, 0.0, 0.0]) for k in range(20, 29)], (3, [0.9, 0.1, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [nan, 0.0, 1.0]), (8, [float("inf"), 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (50, [1.0, 0.0]), (9, [0.0, 1.0]), (3, [0.9, 0.1, 0.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS key", "2 AS g", "'v' AS v")
    got = ann.nearest(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, k, 19 + k) for k in range(1, 6)] + [(50, 1, 9)]
    assert all(abs(r.score - 1) < 1e-12 for r in got[:5])
    assert ann.nearest(d.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    kept, columns = docs, docs.columns
    from tidewake.llm.common import Work

    work = Work(spark, "test")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = work.save(stage(spark, kept, SF), name)
        assert kept.columns == columns
        sizes.append(kept.count())
    assert sizes[0] * 0.7 < sizes[-1] <= sizes[-2] < sizes[0]
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_on_odd_documents(spark, odd):
    """Every stage on nulls, empty and repeated rows and clashing columns, and on no rows at all."""
    import corpus_pipeline
    from tidewake.llm.common import Work

    for docs in (odd, odd.filter("false")):
        work, kept = Work(spark, "odd"), docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = work.save(stage(spark, kept, SF), name)
            assert kept.columns == docs.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
        assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept.collect()}
        ids = {r.doc_id for r in kept.collect()}
        assert not ids & {1, 2, 3, 6, 10} and (docs is not odd or {4, 7, 11} <= ids)
