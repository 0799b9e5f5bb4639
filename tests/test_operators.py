"""Edge cases of the engine's operators."""

import datetime

import numpy as np
import pytest

from tesserae.operators import bm25, chunking, crawl, dense, fusion, metrics, pages
from tesserae.plans.components import components
from tesserae.plans.stage import drop_stages, prefix_sum


def test_prefix_sum_spreads_groups_and_keeps_nulls(spark):
    data = [("a" if i % 3 else None, i, i % 5) for i in range(200)]
    got = {(r.k, r.o): r.cum_v for r in prefix_sum(spark.createDataFrame(data, "k string, o int, v long"), ["k"], ["o"], ["v"]).collect()}
    for key in ("a", None):
        total = 0
        for k, o, v in data:
            if k == key:
                total += v
                assert got[k, o] == total


def test_prefix_sum_of_nothing(spark):
    assert prefix_sum(spark.createDataFrame([], "k string, o int, v long"), ["k"], ["o"], ["v"]).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 110)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 110)} == {100}


def test_bm25_ties_repeats_and_no_match(spark):
    docs = spark.createDataFrame([("b", "uno due"), ("a", "uno due"), ("c", ""), ("d", "tre tre quattro")], "id string, text string")
    asked = spark.createDataFrame([(1, "due"), (2, "niente"), (3, None)], "qid long, text string")
    got = [(r.qid, r.id, r.rank) for r in bm25.topk(docs, asked, 5).orderBy("qid", "rank").collect()]
    assert got == [(1, "a", 1), (1, "b", 2)]


def test_dense_leaves_out_self_and_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id long, embedding array<double>")
    got = [(r.qid, r.id, r.rank) for r in dense.topk(rows, rows.where("id = 1"), 5).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2)]


LISTS = [(1, "x", "dense", 1.0, 1), (1, "y", "dense", 1.0, 2), (1, "y", "sparse", 9.0, 1), (1, "z", "sparse", 3.0, 2)]


def test_fusion(spark):
    rows = spark.createDataFrame(LISTS, "qid long, id string, retriever string, score double, rank int")
    assert {(r.id, r.retriever): r.norm for r in fusion.minmax(rows).collect()} == {("x", "dense"): 1, ("y", "dense"): 1, ("y", "sparse"): 1, ("z", "sparse"): 0}
    assert [r.id for r in fusion.blend(rows).orderBy("rank").collect()] == ["y", "x", "z"]
    assert [r.id for r in fusion.rrf(rows).orderBy("rank").collect()] == ["y", "x", "z"]
    assert [r.id for r in fusion.only_in(rows, "dense", "sparse").collect()] == ["x"]


def test_metrics_without_hits(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "qid long, id string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "z"), (2, "y")], "qid long, id string")
    got = {r.qid: r for r in metrics.per_query(asked, ranked, truth).collect()}
    assert (got[1].precision_at_k, got[1].recall_at_k, got[1].mrr, got[1].ap_at_k) == (0.2, 0.5, 0.5, 0.25)
    assert all(got[q][n] == 0 for q in (2, 3) for n in metrics.NAMES)


def pack(text, size=512, share=0.25):
    import re

    parts = [p for s in re.sub(r"([.!?])\s+", "\\1\x00", text).split("\x00") if s.strip(" ") for p in [s[i : i + size] for i in range(0, len(s), size)]]
    buf, n, out = [], 0, []
    for s in parts:
        if buf and n + len(s) > size:
            out.append(" ".join(buf))
            buf = buf[-max(1, int(len(buf) * share)) :]
            n = sum(map(len, buf))
        buf, n = [*buf, s], n + len(s)
    return out + [" ".join(buf)] * bool(buf)


def test_sentence_packing(spark):
    texts = {1: "Una frase. " * 120, 2: "x" * 1300, 3: "", 4: None, 5: "Corta.", 6: "A" * 500 + ". " + "B" * 500 + ". " + "C" * 30 + "."}
    got: dict = {}
    for r in chunking.pack_sentences(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {k: pack(t) for k, t in texts.items() if t}


def test_crawl(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("x", "y"), (None, "z")], "src string, dst string")
    found = crawl.depths(edges, "a")
    assert {r.url: r.depth for r in found.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    rows = crawl.sitemap(found, "a", datetime.date(2024, 1, 2))
    crawl.write_sitemap(rows, str(tmp_path / "map"))
    assert sorted(map(tuple, crawl.read_sitemap(spark, str(tmp_path / "map")).collect())) == sorted(map(tuple, rows.collect()))


HTML = """<html><head><script>var x = '</p>';</script></head><body><h1 id="firstHeading">Titolo <i>uno</i></h1><div id="mw-content-text">
<h2>Parte</h2><p>Testo <b>primo</b><p>secondo</p><ul><li>uno</li><li>due</li></ul><div class="footer">via</div>
<table class="wikitable"><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><h3>Sotto</h3><img src="/i/a.png" alt="foto"><!-- c -->
<a href="/wiki/index.php/B?x=1#y">b</a></div><a href='C'>c</a></body></html>"""


def test_pages(spark):
    rows = spark.createDataFrame([(1, HTML, "https://s.example/wiki/index.php/A"), (2, None, None)], "page_id long, html string, url string")
    items = [(r.type, r.content, r.context) for r in pages.structured_items(rows, repeat=False).orderBy("url", "pos").collect()]
    once = [
        ("header", "Parte", ["Parte"]), ("paragraph", "Testo primo", ["Parte"]), ("paragraph", "secondo", ["Parte"]), ("list", "- uno\n- due", ["Parte"]),
        ("table", "| A | B |\n|---|---|\n| 1 | 2 |", ["Parte"]), ("header", "Sotto", ["Parte", "Sotto"]), ("image", "foto", ["Parte", "Sotto"]), ("text", "b", ["Parte", "Sotto"]),
    ]
    assert items == once
    again = [(r.type, r.content) for r in pages.structured_items(rows).orderBy("url", "pos").collect()]
    assert again[:7] == [("header", "Parte"), ("text", "Parte"), ("paragraph", "Testo primo"), ("text", "Testo"), ("text", "primo"), ("paragraph", "secondo"), ("text", "secondo")]
    assert pages.items_of('<div id="mw-content-text"><table><tr><td>a</td></tr></table><ul><li> </li></ul><hr>b<img alt="x"></div>') == [("text", None, "a", None, []), ("text", None, "b", None, [])]
    assert pages.items_of("<p>x</p>") == [] and pages.items_of(None) == []
    assert {r.dst for r in pages.links(rows).collect()} == {"https://s.example/wiki/index.php/B"}
    assert {r.dst for r in pages.links(rows, root=None).collect()} == {"https://s.example/wiki/index.php/B", "https://s.example/wiki/index.php/C"}
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.where("page_id = 1").select(pages.page_title(F.col("html"))).collect()] == ["Titolo uno"]


def test_addresses(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    base = "https://s.example/wiki/index.php/A?x=1#y"
    hrefs = ["b", "../b", "./b/./c", "/x/../y", "../../../z", "//h.example/a", "http://o.example/", "?q=1", "#f", "", "mailto:a", "b/..", "b?x=../y"]
    rows = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string").select("h", pages.absolute(F.col("b"), F.col("h")).alias("full")).collect()
    assert {r.h: r.full for r in rows} == {h: urljoin(base, h) for h in hrefs}


def test_page_chunks(spark):
    text = "Una frase di prova per i pezzi. " * 40
    html = f'<h1 id="firstHeading">T</h1><div id="mw-content-text"><h2>A</h2><h2>A</h2><p>{text}</p><ul><li>corta</li></ul><p>coda</p><img src="/i.png" alt="foto"></div>'
    rows = chunking.page_chunks(pages.page_items(spark.createDataFrame([("https://s.example/p", html), ("https://s.example/q", None)], "url string, html string"), repeat=False)).orderBy("pos").collect()
    packed = pack(text + "")
    assert [r.content for r in rows if r.content_type == "text"] == packed and rows[0].headers_context == ["A"] and rows[0].title == "T"
    assert [r.chunk_index for r in rows] == [*range(len(packed)), None] and rows[-1].content == "ALT_TEXT: foto" and rows[-1].metadata.image_url == "https://s.example/i.png"


def test_search_without_broadcast_and_beyond_the_corpus(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"parola{i % 7} comune termine{i % 3}") for i in range(60)] + [("e", None)], "id string, text string")
    asked = spark.createDataFrame([(i, f"parola{i} comune comune") for i in range(7)] + [(9, None)], "qid long, text string")
    one = sorted(tuple(r) for r in bm25.topk(docs, asked, 100).collect())
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 2)
    assert one == sorted(tuple(r) for r in bm25.topk(docs, asked, 100).collect()) and len(one) == 7 * 60


def test_index_that_was_never_written(spark, tmp_path):
    documents, terms = bm25.open_index(spark, f"file://{tmp_path}/none")
    asked = spark.createDataFrame([(1, "parola")], "qid long, text string")
    assert bm25.search(documents, terms, asked).count() == 0


def test_dense_blocks_and_approximate_index(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)], "id long, embedding array<double>").repartition(3)
    asked = rows.where("id % 50 = 0")
    one = sorted(tuple(r) for r in dense.topk(rows, asked).collect())
    found = {(r.qid, r.id) for r in dense.approximate_topk(*dense.build_index(rows), asked).collect()}
    assert len(one) == 40 and len(found & {x[:2] for x in one}) >= 36
    monkeypatch.setattr(dense, "BROADCAST_NUMBERS", 1)
    assert one == sorted(tuple(r) for r in dense.topk(rows, asked, block=7).collect())


def test_asof(spark):
    from tesserae.operators import joins

    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), (None, 3, "z"), ("b", 9, "w"), ("a", None, "v")], "k string, t int, n string")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 20), (None, 2, 30), ("b", 10, 40), ("a", 4, 15)], "k string, t int, p int")
    got = {r.n: r.value.p if r.value else None for r in joins.asof(left, right, "t", ["k"]).collect()}
    assert got == {"x": 20, "y": 10, "z": 30, "w": None, "v": None}


def test_mmr_and_keywords(spark):
    from tesserae.operators import keywords

    rows = spark.createDataFrame([(1, "a", "muro scavo", 0.9), (1, "b", "muro scavo", 0.8), (1, "c", "pozzo", 0.5)], "qid long, id string, text string, relevance double")
    assert [r.id for r in fusion.mmr(rows, 3).orderBy("rank").collect()] == ["a", "c", "b"]
    docs = spark.createDataFrame([(1, "muro romano muro romano pozzo"), (2, "scavo"), (3, None)], "id long, text string")
    plain = [r.term for r in keywords.tfidf(docs, "id", "text", 2).where("id = 1").orderBy("rank").collect()]
    wide = [r.term for r in keywords.tfidf(docs, "id", "text", 2, diversity=0.7).where("id = 1").orderBy("rank").collect()]
    assert plain == ["muro", "muro romano"] and wide[0] == "muro" and "muro" not in wide[1]


def test_files(spark, tmp_path):
    from tesserae.sources import files

    assert files.read_judgements(spark, f"file://{tmp_path}/none") is None
    (tmp_path / "c.json").write_text('[{"chunk_id": "a", "content": "è"}, null, {"chunk_id": "b", "metadata": {"alt_text": "x"}}]', encoding="utf-8")
    assert [(r.chunk_id, r.content) for r in files.read_chunks(spark, f"file://{tmp_path}/c.json", whole_file=True).orderBy("chunk_id").collect()] == [("a", "è"), ("b", None)]
    empty = spark.createDataFrame([], files.FEEDBACK)
    assert not files.export_csv(empty, f"file://{tmp_path}/csv") and files.Settings.of(spark).top_k == 5
    assert not files.write_report(spark.createDataFrame([(0, 0.0)], "num_queries long, avg_mrr double"), f"file://{tmp_path}/r")
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), spark.createDataFrame([(2, "B", False), (3, "", True), (4, "d", None)], "k int, v string, gone boolean")
    assert sorted(map(tuple, files.upsert(old, new, "k", "gone").collect())) == [(1, "a"), (2, "B"), (4, "d")]


def test_stages_are_dropped(spark):
    assert drop_stages(spark) >= 0


if __name__ == "__main__":
    pytest.main([__file__])


def test_dense_many_queries_in_groups(spark, monkeypatch):
    from tesserae.operators import best

    rng = np.random.RandomState(5)
    items = np.round(rng.randn(300, 4), 1)
    items[200:] = items[:100]  # equal scores
    asked = np.concatenate([np.round(rng.randn(30, 4), 1)] * 2)  # each query twice
    rows = spark.createDataFrame([(f"i{i:03d}", v) for i, v in enumerate(items.tolist())], "id string, embedding array<double>").repartition(6)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(asked.tolist())], "id int, embedding array<double>")
    monkeypatch.setattr(best, "ROWS", 150)
    monkeypatch.setattr(dense, "PACK", 40)
    assert best.shares(spark, 30, 5) == (12, 1)
    got = sorted((r.qid, r["rank"], r.id) for r in dense.topk(rows, queries, 5, other=False, block=16).collect())
    score = np.round(asked @ items.T, 9)
    assert got == sorted((q, n + 1, f"i{i:03d}") for q in range(60) for n, i in enumerate(sorted(range(300), key=lambda i: (-score[q, i], i))[:5]))


def test_vectors_of_an_index_are_those_of_its_texts(spark):
    docs = spark.createDataFrame([(1, "anfora anfora romana"), (2, ""), (3, None), (4, "villa romana del porto")], "id int, text string")
    of_texts = {r.id: list(r.embedding) for r in dense.embed(docs).collect()}
    assert {r.id: list(r.embedding) for r in dense.embed_index(bm25.index(docs)).collect()} == of_texts


def test_candidates_are_cut_before_texts(spark):
    rows = spark.createDataFrame([(1, f"d{i}", "anfora " * i, float(i), 1.0 - i / 10) for i in range(6)], "qid int, id string, text string, score double, fused double")
    asked = spark.createDataFrame([(1, "anfora")], "qid int, text string")
    for precut, kept in (("fused", {"d0", "d1"}), ("raw_score", {"d4", "d5"})):
        cut = fusion.precut_to(rows.drop("text"), 2, precut)
        assert {r.id for r in cut.collect()} == kept
        assert sorted(fusion.relevant(cut.join(rows.select("id", "text"), "id"), asked).select("id", "relevance").collect()) == sorted(fusion.scored(rows, asked, 2, precut).select("id", "relevance").collect())


def test_bm25_many_queries_send_k_rows_each(spark, monkeypatch):
    from tesserae.operators import best

    words = [f"parola{i}" for i in range(40)]
    rng = np.random.RandomState(7)
    docs = [(f"d{i:03d}", " ".join(rng.choice(words, 1 + i % 9))) for i in range(400)]
    asked = [(i, " ".join(rng.choice(words, 1 + i % 4))) for i in range(50)] + [(50, "parola1 parola1 parola2"), (51, "parola2 parola1 parola1")]
    docs = spark.createDataFrame(docs, "id string, text string").repartition(8)
    asked = spark.createDataFrame(asked, "qid int, text string")
    indexed = bm25.index(docs)
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 1)
    want = sorted(tuple(r) for r in bm25.search(indexed, bm25.idf(indexed), asked, 5).collect())  # postings joined
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(best, "ROWS", 10)
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 30)
    sent, top = [], bm25.top
    monkeypatch.setattr(bm25, "top", lambda scored, k: sent.append(scored.count()) or top(scored, k))
    assert sorted(tuple(r) for r in bm25.search(indexed, bm25.idf(indexed), asked, 5).collect()) == want
    assert sent == [len(want)]  # no partition's own best beside them
