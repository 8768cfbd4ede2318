"""Source mixing, lexical search and whitening against plain computations, with hard rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from compare import differences, oracle_connection
from millwright.llm import lexical, mixing, queries, whitening
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, source string, size string, `odd.name` int"


def words(n, rng):
    return "".join(f"w{rng.randint(0, 9)}{rng.choice([' ', chr(10), '  ', chr(9)])}" for _ in range(n))


def plain_targets(sizes):
    """Weights 5, 2, 1 in code point order, null last; the excess of full sources is shared out again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in sizes if s not in full)
        found = {s: 2.0 * sizes[s] if s in full else left * weight[s] / rest for s in sizes}
        above = {s for s in sizes if s not in full and found[s] > 2 * sizes[s]}
        if not above:
            return found
        full |= above


def mixing_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "", None, "z", "B", "tiny"])
        rows.append((i, words(rng.choice([0, 1, 3, 40, 200]), rng), source, "x", 1))
    rows += [(700, words(9000, rng), "b", None, None), (701, None, "a", None, None), (702, " \n\t", "nothing", None, None)]
    rows += [(None, "one two", "z", None, None)] * 3 + [(703, "same rows twice", "a", None, None)] * 5
    return rows


def test_every_source_comes_near_its_target(spark):
    rows = mixing_rows()
    found = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7))
    assert found.columns == ["doc_id", "text", "source", "odd.name", "size", "source_size", "target", "taken"]
    got = found.collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(sizes)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) == math.floor(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= mixing.PIECE for s in sizes)


def test_every_document_is_used_once_before_any_is_used_twice(spark):
    for r in mixing.mix(spark.createDataFrame(mixing_rows(2), DOCS)).groupBy("source", "target", "source_size").agg(
        F.count_if((F.col("taken") < F.col("size"))).alias("part"), F.count_if(F.col("taken") > F.col("size")).alias("more")
    ).collect():
        assert not (r["part"] and r["more"])


def test_mix_does_not_depend_on_the_layout(spark):
    rows = mixing_rows(3)
    one = spark.createDataFrame(rows, DOCS).coalesce(1)
    many = spark.createDataFrame(rows[::-1], DOCS).repartition(13)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(mixing.mix(one).collect(), key=key) == sorted(mixing.mix(many).collect(), key=key)


def test_mixed_texts_hold_the_taken_words(spark):
    mixed = mixing.mix(spark.createDataFrame(mixing_rows(4), DOCS).where("doc_id < 600"))
    taken = {r["doc_id"]: (r["taken"], r["text"]) for r in mixed.collect()}
    got = defaultdict(list)
    for r in mixing.mixed_texts(mixed).collect():
        got[r["doc_id"]].append(r["text"])
    for id, (n, text) in taken.items():
        assert sum(len(t.split()) for t in got[id]) == n
        assert all(text.startswith(t) for t in got[id])


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    only = spark.createDataFrame([(1, None, None, None, None), (2, "", "a", None, None)], DOCS)
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(only).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def plain_search(items, docs, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    bags = [(id, Counter(term.findall((text or "").translate(low)))) for id, text, *_ in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text, *_ in items:
        scores = []
        for (id, bag), size in zip(bags, lengths):
            m = 25 + (75 * size * n) // max(total, 1)
            score = 0
            for t in term.findall((text or "").translate(low)):
                if bag[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, id is None, id or 0))
        for rank, (score, missing, id) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if missing else id, -score))
    return sorted(out, key=str)


def search_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)] + ["Été", "ÀB", "日本語", "x1", "common"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        return rng.choice([" ", "-", "\n", "; "]).join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(vocabulary, weights, k=n))

    docs = [(i, text(rng.choice([1, 5, 40, 300])) + " common") for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # copies: equal scores by id
    docs += [(2000, None), (2001, ""), (2002, " -- "), (2003, text(30_000)), (None, docs[7][1]), (None, "only here"), (5, text(9)), (5, text(9))]
    rng.shuffle(docs)
    items = [(i, text(rng.choice([1, 3, 20, 80]))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, docs[3][1]), (54, "only HERE here"), (54, "common"), (None, "t1 t1 t2")]
    return items, docs


@pytest.mark.parametrize("shard_bytes,block_bytes", [(8 << 20, 1 << 20), (3_000, 500)])
def test_search_matches_scoring_everything(spark, shard_bytes, block_bytes):
    items, docs = search_rows(9)
    left = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, score int")
    right = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, shard string").repartition(3)
    found = lexical.search(left, right, shard_bytes=shard_bytes, block_bytes=block_bytes)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_search(items, docs)


def test_search_of_nothing(spark):
    items, docs = spark.createDataFrame([(1, "a")], "item_id bigint, text string"), spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    for left, right in ((items.limit(0), docs), (items, docs.limit(0)), (items, docs.select("doc_id", F.lit(None).cast("string").alias("text")))):
        assert lexical.search(left, right).collect() == []


def test_search_scores_few_documents(monkeypatch):
    """Bounds must end a search for rare terms long before every document was scored."""
    rng = np.random.default_rng(3)
    size = 5_000
    lengths = np.full(size, 50)
    common = (np.arange(size), np.ones(size, np.int64))
    rare = (np.sort(rng.choice(size, 12, replace=False)), np.full(12, 3))
    shard = lexical.Shard(lengths, [common, rare], np.array([1, 9000]), size, 50 * size)
    scored = 0
    looked = np.searchsorted

    def counting(keys, wanted, *rest):
        nonlocal scored
        scored += len(wanted)
        return looked(keys, wanted, *rest)

    monkeypatch.setattr(lexical.np, "searchsorted", counting)
    found, _ = shard.search(np.array([0, 1]), np.array([1, 1]), 10)
    assert set(found) <= set(rare[0].tolist()) and scored < 200


def test_search_matches_sql(spark, sf_dir):
    assert differences(queries.op12_lexical_search(spark, sf_dir), oracle_connection(sf_dir), queries.OP12_SQL) is None


VECTORS = "vec_id bigint, embedding array<float>, component int"


def plain_whitening(vectors):
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    distinct = np.unique(x, axis=0)
    centred = distinct - distinct.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(distinct))
    return x, distinct, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("dim,rows", [(1, 40), (3, 200), (12, 400), (64, 300)])
def test_whitening_matches_a_dense_solver(spark, dim, rows):
    rng = np.random.default_rng(dim)
    vectors = (rng.standard_normal((rows, dim)) * np.linspace(3, 0.5, dim)).astype(np.float32)
    vectors[: rows // 3] = vectors[0]  # a third of the rows share one vector
    data = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    bad = [(-1, None, 1), (-2, [None] * dim, 1), (-3, [float("nan")] * dim, 1), (-4, [float("inf")] * dim, 1), (-5, [1.0] * (dim + 1), 1), (-6, [], 1)]
    got = whitening.whiten(spark.createDataFrame(data + bad, VECTORS)).toPandas()
    count = min(4, dim)
    assert len(got) == rows * count and set(got.vec_id) == set(range(rows))
    x, distinct, values, axes = plain_whitening(vectors)
    n, sums = len(distinct), distinct.sum(axis=0)
    for c in range(count):
        mine = got[got.component == c + 1].set_index("vec_id").loc[range(rows)]
        want = (x - distinct.mean(axis=0)) @ axes[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine.whitened - want).max(), np.abs(mine.whitened + want).max()) < 1e-9
        assert np.allclose(mine.explained, values[c] / values.sum(), rtol=1e-10)
        assert (mine.n == n).all() and (mine.deviation == ((n * x - sums) ** 2).sum(axis=1)).all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_whitening_is_the_same_again(spark, sf_dir):
    run = lambda: sorted(map(tuple, queries.op13_embedding_whitening(spark, sf_dir).collect()))
    assert run() == run()


def test_whitening_of_little(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance at all
    flat = whitening.whiten(frame([(1, [1.0, 1.0]), (2, [2.0, 1.0]), (None, [3.0, 1.0])])).toPandas()
    assert list(flat.component) == [1, 1, 1] and flat.vec_id.isna().sum() == 1  # one direction varies
    far = whitening.whiten(frame([(1, [2.0**40, 0.0]), (2, [-(2.0**40), 0.5]), (3, [1e30, 1.0])])).toPandas()
    assert set(far.vec_id) == {1, 2} and far.deviation.isna().all()


def test_solver_on_hard_spectra():
    rng = np.random.default_rng(2)
    for values in (np.r_[5.0, 5.0, 5.0, 5.0, 5.0, np.ones(35)], np.linspace(2, 1, 150), np.r_[1e12, 1.0, 1e-6, np.zeros(30)]):
        turn, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
        dense = (turn * values) @ turn.T
        found, vectors = whitening.leading_pairs(lambda v: dense @ v, len(values), 4)
        assert np.allclose(found, np.sort(values)[::-1][:4], rtol=1e-12, atol=1e-13 * values.max())
        assert np.linalg.norm(dense @ vectors - vectors * found, axis=0).max() <= 1e-13 * values.max()
        assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
