"""HTML extraction, WARC round trip, neighbour search and the pipeline."""

import re
import time
import tracemalloc
from html import escape, unescape

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from millwright.llm import ann, html_blocks, simhash, warc

PAGE = "page_id bigint, url string, html string"


def article(html):
    body = html[html.index("<article>") + 9 : html.index("</article>")]
    parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:h1|p)>", body))
    return "\n".join(p for p in parts if p)


def test_extraction_equals_the_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = html_blocks.extract(pages, html_blocks.fit_labeller(pages)).collect()
    assert np.mean([r["text"] == article(r["html"]) for r in found]) > 0.95


def test_blocks_of_hard_markup():
    parse = lambda h: [b.text for b in html_blocks.blocks(h)]
    assert parse("") == [] and parse("plain &amp; &#233;\n text") == ["plain & é text"]
    assert parse("<p>a<b>b</b> c<br>d<p title='x>y'>e<script>var t='<p>no</p>'</script>f") == ["ab c d", "ef"]
    assert parse("<!-- <p>no</p> --><p>yes") == ["yes"]
    assert parse("<head><title>no</title><body><p>head left open</p>") == ["head left open"]
    deep = html_blocks.blocks("<div>x" * 20_000 + "</i></div>y")
    assert len(deep) == 20_001 and max(len(b.path) for b in deep) == html_blocks.PATH_ELEMENTS
    assert parse("<p>" + "word " * 50_000 + "</p></div></div><li>z") == [("word " * 50_000).strip(), "z"]


def test_nothing_after_unclosed_elements_is_dropped():
    parse = lambda h: [b.text for b in html_blocks.blocks(h)]
    assert parse('<p>a</p><svg class="i"/><p>article text</p>') == ["a", "article text"]
    assert parse("<p>a</p><svg><p>article text</p><svg><text>x</text></svg><p>z") == ["a", "article text", "z"]
    assert parse("<p>one <svg><g><text>x</text></g></svg> two</p>") == ["one two"]
    for name in ("object", "noscript", "select", "template"):
        assert parse(f"<p>a</p><{name}><p>article text</p>") == ["a", "article text"]
    assert parse("<noscript><p>article</p> text</noscript>") == ["article", "text"]
    assert parse("<p>one <noscript><img src=x><iframe src=y></iframe> </noscript>two</p>") == ["one two"]
    assert parse("<select><option>x<option>y</select><template><p>t</p></template><p>z") == ["z"]
    assert parse("<p title=\"it's>one</p><p>don't two</p>") == ["one", "don't two"]
    assert parse("<p don't>one</p><a href=it's>two</a><!-->three") == ["one", "twothree"]
    assert parse("<title-bar>kept</title-bar><script >x</script foo>y<svg") == ["kept", "y"]


def test_every_query_has_all_the_neighbours_there_are(spark):
    """Visits go on past the calibrated number until the leaves hold k ids beside the query's own."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(600, 4)), 50 + 40 * rng.normal(size=(12, 4))])
    made = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(600, [900.0, 1.0, 1.0, float(k)]) for k in range(20)]
    rows = spark.createDataFrame(made, "vec_id bigint, embedding array<double>")
    found = ann.nearest(rows, F.expr("vec_id >= 600 or vec_id % 50 = 0"), k=10, target=0.01).groupBy("query_id").count().collect()
    assert len(found) == 24 and all(r["count"] == 10 for r in found)
    tree = ann.Tree(points)
    assert len(tree.visits(points[0], 1, {leaf: 1 for leaf in range(tree.leaves)}, 5)) == min(5, tree.leaves)
    assert len(tree.visits(points[0], 1, {}, 5)) == tree.leaves


def test_hard_markup_takes_linear_time():
    start = time.monotonic()
    for piece in ('<p "', "<p '", '<p a="', "<p a='x", "<svg>", "<svg/>", "<object>", "<noscript>", "<noscript> <b>", "</svg", "<select><!--", "<script", "</script ", '<div class="'):
        html_blocks.blocks(piece * (2**20 // len(piece)))
    assert time.monotonic() - start < 14 * 4


def test_a_very_long_page_among_short_ones(spark, sf_dir):
    """The peak of what Python allocates stays far below a padded batch of such pages."""
    seen = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").limit(40).collect()]
    model = html_blocks.train(seen, steps=40)
    long = "<body><article>" + "".join(f'<li id="n{i}">item {i}' for i in range(20_000)) + "</article>"
    tracemalloc.start()
    texts = html_blocks.main_texts(model, [*seen, long, *seen])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and len(texts) == 81
    assert texts[:40] == texts[41:] == html_blocks.main_texts(model, seen)
    assert html_blocks.main_texts(model, [long])[0] == texts[40]


def test_a_sample_of_long_pages_only_still_teaches(spark, monkeypatch):
    monkeypatch.setattr(html_blocks, "SAMPLE_CHARS", 10)
    monkeypatch.setattr(html_blocks, "train", lambda samples: html_blocks.Labeller(540) if samples else None)
    rows = spark.createDataFrame([(1, "u", "<article><p>some main text</p></article><nav><p>menu</p></nav>" * 300)], PAGE)
    assert html_blocks.fit_labeller(rows) is not None


def test_extraction_of_layouts_that_were_never_seen(spark, sf_dir):
    """Boxes and containers that the taught pages do not have, filled with the same kind of words."""
    seen = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()]
    model = html_blocks.train(seen)
    wrong = told = 0
    for k, html in enumerate(seen[:40]):
        first, *rest = [x for x in article(html).split("\n") if x]
        box = " ".join(" ".join(rest).split()[:40])
        inside = [f"<p>{escape(x)}</p>" for x in rest]
        inside.insert(1, f'<div class="newsletter-signup"><h4>{escape(first)} A</h4><p>{escape(box)} B</p></div>')
        inside.insert(1, f"<ul><li>{escape(box[:30].strip())}</li><li>{escape(box)} C</li></ul>")
        start, end = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-body">', "</div>")][k % 3]
        comments = f'<section id="comments"><h2>{escape(box[:20])} D</h2><div class="comment"><p>{escape(box)} E</p></div></section>'
        page = f"<body><header><p>{escape(box)} F</p></header>{start}<h1>{escape(first)}</h1>{''.join(inside)}{end}{comments}<footer>{escape(box)} G</footer>"
        want = {first, *rest, box[:30].strip(), f"{box} C"}
        found = set(html_blocks.main_texts(model, [page])[0].split("\n"))
        wrong += len(want ^ found)
        told += len(html_blocks.blocks(page))
    assert wrong / told < 0.1


def test_extraction_of_null_empty_and_clashing(spark):
    rows = spark.createDataFrame([(1, None, None), (1, "u", ""), (2, "u", "<p></p>")], "page_id bigint, text string, html string")
    assert [r["text"] for r in html_blocks.extract(rows, html_blocks.fit_labeller(rows)).collect()] == ["", "", ""]
    assert html_blocks.fit_labeller(rows.limit(0)) is None


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    pages, labels = [rng.normal(size=(n, 5)).astype(np.float32) for n in (3, 6)], [np.array([1, 0, -1]), np.array([0, 1, 1, 0, 1, 0])]
    model = html_blocks.Labeller(5, hidden=4, seed=1)
    losses = []
    moments = {}
    for _ in range(150):
        losses.append(model.fit(pages, labels, moments, 0.05))
    assert losses[-1] < 0.05 < losses[0]
    # Scores come another way than the states that teaching keeps.
    given = [p @ np.concatenate([model.weights["xf"], model.weights["xb"]], axis=1) + np.concatenate([model.weights["bf"], model.weights["bb"]]) for p in pages]
    x, mask = model.padded(pages)
    both = np.concatenate([model._run(x, mask, "f")[0], model._run(x, mask, "b")[0]], axis=2)
    taught = html_blocks.sigmoid(both @ model.weights["out"] + model.weights["bias"])
    for k, p in enumerate(model.scores(given)):
        assert np.allclose(p, taught[: len(pages[k]), k], atol=1e-5)
        assert np.allclose(p, model.scores([given[k]])[0], atol=1e-5)


def test_archives_come_back_through_the_index(spark):
    same = "y" * 200
    rows = [(3, "http://a.b/x", same), (2, "http://a.b/x", same), (5, None, None), (None, "http://[bad", None), (4, "http://a.b/x\n%0A", same)]
    rows += [(6, "u", "z" * 50), (7, "u", "z" * 50), (2, "http://a.b/x", same), (None, "q", same), (8, "http://w.example.org:8080/é?q#f", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, PAGE)
    found = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_round_trip(pages).collect()]
    want = [(3, "revisit", 2, 200), (2, "response", None, 200), (2, "response", None, 200), (5, "response", None, 0), (None, "response", None, 0)]
    want += [(4, "revisit", 2, 200), (6, "response", None, 50), (7, "response", None, 50), (None, "response", None, 200), (8, "response", None, 240)]
    key = lambda r: (r[0] or 0, r[1], r[3])
    assert sorted(found, key=key) == sorted(want, key=key)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_index_finds_every_key_over_many_small_blocks(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.org/{i % 3}", "p" * (100 + i)) for i in range(300)]
    captures = warc.write_archives(spark.createDataFrame(rows, PAGE), f"file://{tmp_path}/w", archive_bytes=2000)
    index = warc.write_index(captures, f"file://{tmp_path}/w", block=4, file_captures=50)
    assert index.count() > 3
    found = warc.read_records(captures, index).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in found) == sorted((i, h) for i, _, h in rows)
    known = warc.CaptureIndex([tuple(r) for r in index.collect()])
    key = warc.url_key("http://h3.example.org/1")
    assert sorted(c[1] for c in known.find(key, any_id=True)) == [i for i in range(300) if i % 7 == 3 and i % 3 == 1]
    assert list(known.find("none)", any_id=True)) == []


def test_url_keys_reverse_the_host():
    assert warc.url_key("https://Www.Example.org/a?b#c") == "org,example,www)/a?b"
    assert warc.url_key("http://e.org:81") == "org,e:81)/" and warc.url_key(None) == "" and warc.url_key("http://[x") == "http://[x"


def brute(ids, rows, query, k=10):
    far = np.sqrt(((rows - rows[query]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, far)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(far[i])) for i in order]


def test_neighbours_reach_their_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = ann.nearest(table, F.col("vec_id") % 20 == 0, calibration=10, chunk_rows=50, chunk_queries=3).collect()
    data = table.toPandas()
    ids, rows = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == ids[q])
        want = brute(ids, rows, q)
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        hits += len({m[1] for m in mine} & {w[0] for w in want})
        total += len(want)
    assert hits / total >= 0.9


def test_neighbours_of_equal_broken_and_few_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 0.0]), (101, None), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [1.0]), (200, [0.0, 1.0]), (200, [0.0, 1.0]), (None, [1.0, 0.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 10 == 0).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {0, 10, 20, 30, 200}
    assert sorted(by[10]) == [(i + 1, v, 0.0) for i, v in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9])]
    assert sorted(by[200])[0] == (1, 0, 2**0.5)
    few = spark.createDataFrame(rows[:2], "vec_id bigint, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert ann.nearest(few.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language id", "near duplicates", "substring dedup", "packing"]
    quality, language, near, cut, pack = (f for _, f in corpus_pipeline.STAGES)
    for stage in (quality, language, near, cut):
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    kept = {r["doc_id"] for r in near(spark, docs, sf_dir).select("doc_id").collect()}
    parts = simhash.simhash_report(docs).collect()
    assert kept == {r["component_id"] for r in parts}
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
