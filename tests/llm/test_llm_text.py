"""Quality rules, language id, language model, BPE and packing against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpus_pipeline import quality_stage
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millwright.llm import bpe, langid, lm, packing, quality, shared, tokens
from millwright.llm.queries import TOKENIZER

HARD = [None, "", " \n\t ", "é", "<|endoftext|>a<|endoftext|>", "a" * 3000, " " * 3000, "日本語🙂‍ x", "it's  we'll\n\n 12 34!!", "\x85\xa0 ſ"]


def frame(spark, rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    return spark.createDataFrame(rows, schema)


def plain_base(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def test_base_statistics_match_plain_python(spark):
    rng = random.Random(2)
    texts = [*HARD, "a b c d e " * 4, "one\n one\none\n\none", "x #*$%&|<> y\x0bz"] + [
        " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", "\na b"]) for _ in range(60)
    ]
    found = quality.base_statistics(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in found.collect()} == {i: plain_base(t) for i, t in enumerate(texts)}


def plain_step(rows, mean, cov, exact=False):
    """One concentration step in numpy, by bins of the distance or by the distance itself."""
    d = np.einsum("ij,jk,ik->i", rows - mean, np.linalg.inv(cov), rows - mean)
    b = d if exact else np.floor(np.log(d + 1e-6) * quality.BINS_PER_UNIT)
    near = rows[b <= np.sort(b)[math.ceil(quality.KEPT_SHARE * len(b)) - 1]]
    return near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(np.array(quality.SCALE) ** 2)


def volume(cov):
    return np.linalg.slogdet(cov)[1]


def plain_fits(rows):
    """The fits that each start of a group ends in, by the same rules in numpy."""
    scale = np.array(quality.SCALE)
    bins = np.sort(np.floor(rows / scale * quality.BINS_PER_UNIT), axis=0)
    q1, q2, q3 = (bins[max(0, math.ceil(len(bins) * q / 4) - 1)] for q in (1, 2, 3))
    middle, wide = (q2 + 0.5) / quality.BINS_PER_UNIT * scale, np.maximum((q3 - q1) / 1.349 / quality.BINS_PER_UNIT, 1) * scale
    z = (rows - middle) / wide
    signs = z / np.sqrt(np.maximum((z**2).sum(axis=1), 1e-12))[:, None]
    floor, sides = np.diag(scale**2), np.outer(wide, wide)
    out = []
    for cov in (floor, np.diag(wide**2), np.cov(np.tanh(z).T, bias=True) * sides + floor, signs.T @ signs / len(z) * sides + floor):
        mean, cov = plain_step(rows, middle, cov)
        while True:
            after = plain_step(rows, mean, cov)
            if volume(after[1]) >= volume(cov) - quality.LEAST_FALL:
                break
            mean, cov = after
        out.append((mean, cov))
    return out


def plain_fit(rows):
    return min(plain_fits(rows), key=lambda fit: volume(fit[1]))


def ridge(seed):
    """Rows along a ridge, and one in five in a second cluster beside it near the medians."""
    rng = np.random.default_rng(seed)
    along = rng.normal(0, 1, (800, 1))
    main = along * [9.0, 0.9, 4.0, 0.0] + rng.normal(0, 0.02, (800, 4))
    beside = rng.normal(0, 1, (200, 4)) * [0.1, 0.01, 0.1, 0.1] + [2.0, -0.6, 1.5, 0.4]
    return np.concatenate([main, beside])


def test_least_determinant_of_several_starts_and_of_random_ones(spark):
    groups = {f"={seed}": ridge(seed) for seed in range(3)}
    rows = spark.createDataFrame([(k, "=s", *map(float, r)) for k, own in groups.items() for r in own], ["k1", "k2", *quality.VECTOR])
    found = quality.least_determinants(rows, quality.centres(rows)).collect()
    assert len(found) == len(groups)
    rng = np.random.default_rng(0)
    lower_than_first = 0
    for r in found:
        own = groups[r["k1"]]
        ends = [volume(cov) for _, cov in plain_fits(own)]
        assert r["volume"] == pytest.approx(min(ends), abs=1e-6) and r["total"] == len(own)
        lower_than_first += ends[0] > min(ends) + 0.1
        # Random starts of five rows, concentrated on exact shares: none ends lower but for the width of a bin.
        for _ in range(100):
            few = own[rng.choice(len(own), 5, replace=False)]
            mean, cov = few.mean(axis=0), np.cov(few.T, bias=True) + np.diag(np.array(quality.SCALE) ** 2)
            for _ in range(30):
                mean, cov = plain_step(own, mean, cov, exact=True)
            assert r["volume"] <= volume(cov) + 0.1
    assert lower_than_first


def test_outliers_match_an_estimate_in_numpy(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        word = "ab" if i % 2 else "abcdefgh"
        text = " ".join(word + rng.choice("xyz") * rng.randint(0, 3) + str(rng.randint(0, 9999)) for _ in range(rng.randint(12, 80)))
        if i % 10 == 0:
            text = text.replace(" ", "### ")
        rows.append((i, text, "en" if i % 2 else None, "s" if i < 390 else "few", 0))
    found = quality.quality_rules(frame(spark, rows)).withColumns(dict(zip(quality.VECTOR, quality.statistic_vector(), strict=True))).collect()
    groups, every = collections.defaultdict(list), []
    for r in found:
        v = [r[c] for c in quality.VECTOR]
        groups[r["lang"], r["source"]].append(v)
        every.append(v)
    fits = {k: plain_fit(np.array(v)) for k, v in groups.items() if len(v) >= quality.MIN_GROUP}
    pooled = plain_fit(np.array(every))
    for r in found:
        mean, cov = fits.get((r["lang"], r["source"]), pooled)
        d = np.array([r[c] for c in quality.VECTOR]) - mean
        assert r["outlier_distance"] == pytest.approx(float(d @ np.linalg.inv(cov) @ d), rel=1e-6)
        assert r["kept"] == (r["outlier_distance"] <= quality.CUT)
    assert {r["doc_id"] for r in found if not r["kept"]} >= {i for i in range(0, 400, 10)}


def test_small_groups_are_judged_by_their_language(spark):
    rng = random.Random(12)

    def text(size):
        return " ".join("".join(rng.choices("abcdefgh", k=size + rng.randint(0, 1))) for _ in range(100))

    rows = [(i, text(4), "en", f"s{i % 5}", 0) for i in range(300)]
    rows += [(1000 + i, text(12), "fi", f"domain{i % 15}", 0) for i in range(30)]
    rows += [(2000, text(30), "fi", "domain1", 0), (2001, text(30), "en", "domain1", 0), (2002, text(4), "xx", "domain1", 0)]
    docs = frame(spark, rows)
    kept = {r["doc_id"] for r in quality_stage(spark, docs, "").collect()}
    assert len(kept & set(range(1000, 1030))) >= 29 and len(kept & set(range(300))) >= 297
    assert not kept & {2000, 2001} and 2002 in kept


def test_quality_rules_on_empty_null_and_clashing(spark):
    rows = frame(spark, [(1, None, None, None, 1), (2, "", "x", "y", 2)]).withColumnRenamed("n_chars", "kept")
    assert [r["kept"] for r in quality.quality_rules(rows).collect()] == [False, False]
    assert quality.quality_rules(rows.limit(0)).count() == 0
    bare = quality.quality_rules(rows, carry_text=False)
    assert bare.columns == [c for c in quality.quality_rules(rows).columns if c != "text"]
    assert [r["kept"] for r in bare.collect()] == [False, False]


def test_quality_plan_has_no_python(spark, sf_dir):
    plan = quality.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_language_id_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = langid.identify(docs, langid.fit_dictionaries(docs.where(~held))).where(held).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.85
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_id_defined_results():
    choose = langid.Identifier({"en": b" the and of to in ", "de": " der die und für ".encode()})
    assert choose(None) == choose("") == choose("123 !?") == ("und", 0.0)
    assert choose("der die und der für die")[0] == "de" and choose("THE AND OF TO IN")[0] == "en"
    assert choose("the and " * 50_000)[0] == "en"
    assert langid.Identifier({})("text") == ("und", 0.0) and langid.Identifier({"en": b"x"})("text") == ("en", 1.0)


def test_language_id_ignores_null_rows_and_clashes(spark):
    rows = frame(spark, [(1, "the cat", "en", "s", 0), (2, None, "en", "s", 0), (3, "x", None, "s", 0)]).withColumnRenamed("source", "score")
    known = langid.fit_dictionaries(rows)
    assert list(known) == ["en"]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(rows, known).collect()} == {1: "en", 2: "und", 3: "en"}
    assert langid.fit_dictionaries(rows.limit(0)) == {}


def plain_lm(rows, held, mu):
    """Exact counts, quantised as the filter does, without its false hits."""

    def words(t):
        return (t or "").encode().lower().split() + [b" "]

    one, two = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = words(t)
            one.update(w)
            two.update(zip([b" ", *w], w))
    total, size = sum(one.values()), len(one)
    out = {}
    for i, t in rows:
        base = score = 0.0
        for a, b in zip([b" ", *words(t)], words(t)):
            p = (one[b] + 1) / (total + size + 1)
            c2 = 2.0 ** (two[a, b].bit_length() - 1) if two[a, b] else 0.0
            base += math.log10(p)
            score += math.log10((min(c2, one[a]) + mu * p) / (one[a] + mu))
        out[i] = (len(words(t)), sum(one[x] > 0 for x in words(t)), total, base, score)
    return out


def test_language_id_of_scripts_without_spaces(spark):
    """Japanese, Chinese and Thai sentences made of a few phrases each, held out by position."""
    rng = random.Random(5)
    phrases = {
        "ja": ["今日は", "天気が", "とても", "良いです", "私は", "学校に", "行きました", "本を", "読んでいます", "東京の", "電車で"],
        "zh": ["今天", "天气", "非常好", "我们", "学校里", "看书", "北京的", "火车上", "他们说", "没有问题", "这个城市"],
        "th": ["วันนี้", "อากาศ", "ดีมาก", "ฉันไป", "โรงเรียน", "อ่านหนังสือ", "ที่กรุงเทพ", "โดยรถไฟ", "พวกเขา", "ไม่มีปัญหา"],
    }
    made = [(i, "".join(rng.choices(phrases[lang], k=12)), lang) for i in range(240) for lang in [("ja", "zh", "th")[i % 3]]]
    rows = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    found = langid.identify(rows.where("doc_id >= 160"), langid.fit_dictionaries(rows.where("doc_id < 160"))).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found) and len(found) == 80


def test_any_number_of_languages(spark):
    """600 labels, each with words of its own: every text gets its label, also in groups of other sizes."""
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(25)] for rng in map(random.Random, range(600))]
    made = [(n * 2 + half, " ".join(words[n][half : 24 + half]), f"l{n:03}") for n in range(600) for half in (0, 1)]
    rows = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    known = langid.fit_dictionaries(rows.where("doc_id % 2 = 0"))
    assert len(known) == 600
    texts = [t for i, t, _ in made if i % 40 == 1]
    few = langid.Identifier(known, at_once=7).choose(texts)
    assert few == langid.Identifier(known, at_once=1000).choose(texts)
    assert sum(f[0] == lang for f, lang in zip(few, [lang for i, _, lang in made if i % 40 == 1], strict=True)) >= len(texts) * 0.95


def test_every_word_and_piece_counts():
    choose = langid.Identifier({"en": b" the and of to in ", "de": " der die und für ".encode()})
    assert choose("die " + "the " * 40)[0] == "en" and choose("the " + "die und " * 40)[0] == "de"
    long = " und ".join(["der die für"] * 20_000)
    assert sum(map(len, langid.pieces(long))) == len(long.encode()) + 2 and choose(long)[0] == "de"
    assert langid.pieces("12 -- 3") == [] and b"".join(langid.pieces("हिन्दी 12 है")).decode() == " हिन्दी है "


@pytest.mark.parametrize("size", [1 << 30, 2000])
def test_scores_match_exact_counts_but_for_false_hits(spark, sf_dir, size):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.union(frame(spark, [(10**6 + i, t, None, None, 0) for i, t in enumerate(HARD)]).select(docs.columns))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = frame(spark, [(i, t, None, None, 0) for i, t in rows])
    want = plain_lm(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, 50.0)
    found = lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, mu=50.0, broadcast_bytes=size).collect()
    assert len(found) == len(rows)
    for r in found:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert score - 1e-6 <= r["score"] <= score + 0.1 * n


@pytest.mark.parametrize("block", [1 << 10, 8 << 20])
def test_a_model_too_large_to_send_scores_the_same(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300).select("doc_id", "text")
    long = [(10**6, "word1 word2 " * (lm.SLICE_BYTES // 5)), (10**6 + 1, None), (None, ""), (None, "word1"), (7, "word1 word2"), (7, "word1 word2")]
    docs = docs.union(spark.createDataFrame(long, docs.schema)).coalesce(2)
    once, often = (sorted(map(str, lm.score(docs, F.col("doc_id") % 7 == 2, broadcast_bytes=size).collect())) for size in (1 << 30, 0))
    assert len(once) == docs.count() and often == once


def test_segments_grow_with_the_training_text_and_change_no_score(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200)
    assert lm.segment_bits(docs) == lm.LEAST_SEGMENT_BITS and lm.segment_bits(docs.limit(0)) == lm.LEAST_SEGMENT_BITS
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    found = []
    for text in (lm.SEGMENT_TEXT, size >> 13):
        monkeypatch.setattr(lm, "SEGMENT_TEXT", text)
        bits = lm.segment_bits(docs)
        words = {k: n for r in lm.fit_model(docs, bits).collect() for k, n in zip(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int64), strict=True)}
        found.append((bits, words))
    assert found[0][0] < found[1][0] and found[0][1] == found[1][1]


def test_counts_of_a_segment_are_combined_on_the_way(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.integers(0, 3, 4000)), rng.integers(1, 3, 4000), rng.integers(0, 50, 4000), rng.integers(1, 9, 4000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 100]) for c in rows], names=list("sohn")) for i in range(0, 4000, 100)]
    whole = [[c.to_pylist() for c in row] for row in lm.build_segments(iter(batches))]
    monkeypatch.setattr(lm, "HELD_ROWS", 150)
    assert [[c.to_pylist() for c in row] for row in lm.build_segments(iter(batches))] == whole and len(whole) == 3


def shuffled_rows(df):
    """Rows that cross the shuffles of a collected frame."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        if plan.metrics().contains("shuffleRecordsWritten"):
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_answers_of_a_large_model_come_in_chunks_and_not_key_by_key(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300).select("doc_id", "text").coalesce(1)
    keys = {w for r in docs.collect() for w in (r["text"] or "").lower().split()}
    keys |= {p for r in docs.collect() for t in [(r["text"] or "").lower().split()] for p in zip(t, t[1:])}
    found = lm.score(docs, F.col("doc_id") % 7 == 2, broadcast_bytes=0)
    assert len(found.collect()) == docs.count()
    assert 0 < shuffled_rows(found) <= docs.count() + 2**lm.LEAST_SEGMENT_BITS < len(keys)


def test_a_model_larger_than_its_text_is_asked_by_blocks(spark):
    rows = spark.createDataFrame([(i, " ".join(chr(0x4E00 + (i * k) % 5000) for k in range(60))) for i in range(80)], "doc_id bigint, text string")
    held = F.col("doc_id") % 7 == 2
    size = lm.text_bytes(rows.where(~held))
    model = lm.fit_model(rows.where(~held), lm.segment_bits(rows.where(~held)))
    assert model.agg(F.sum(lm.model_bytes())).first()[0] > size
    once, asked = (lm.score(rows, held, broadcast_bytes=n) for n in (1 << 30, size))
    assert sorted(map(str, once.collect())) == sorted(map(str, asked.collect())) and once.count() == 80
    assert shuffled_rows(once) == 0 < shuffled_rows(asked)


def test_a_block_that_two_tasks_read_is_answered_once(monkeypatch):
    """Two tasks ask with texts of one block, and a third with another; counts add up, also large and unlearned ones."""
    texts = [["b a b", "a c " * 200], ["c a", None], ["a b"]]
    held = [[False, False], [False, True], [True]]
    blocks = [[7, 7], [7, 7], [9]]
    rows = [pa.RecordBatch.from_arrays([pa.array(b), pa.array(h), pa.array(t, pa.string())], names=list("bht")) for b, h, t in zip(blocks, held, texts, strict=True)]
    whole = [pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*(r.columns for r in rows), strict=True)], names=list("bht"))]

    def asked(tasks):
        made = [pa.RecordBatch.from_arrays(c, names=lm.CHUNK.names) for task in tasks for c in lm.asked_keys(iter(task), 2)]
        chunks = pa.Table.from_batches(made).sort_by([("segment", "ascending"), ("block", "ascending")])
        return [[c.to_pylist() for c in row] for row in lm.answered(iter(chunks.to_batches(max_chunksize=2)), 2)]

    found = asked([[r] for r in rows])
    assert found == asked([whole])
    assert sum(map(sum, (row[5] for row in found))) == 3 + 400 + 2 + 3 and sum(map(sum, (row[4] for row in found))) == 4
    counts = {n for row in found for b, c in zip(row[1], row[2], strict=True) if b == 7 for n in np.frombuffer(c, np.int64).tolist()}
    assert counts == {1 + 200 + 1, 2, 201, 3}
    monkeypatch.setattr(lm, "SENT_KEYS", 1)
    assert asked([[r] for r in rows]) == found


def test_shuffle_files_of_a_clean_write_go_with_it(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    setting = spark.conf.get(shared.CLEANUP, None)
    before = held.size()
    rows = shared.written(spark.range(100).repartition(3, "id"), "clean", clean=True)
    assert held.size() <= before and spark.conf.get(shared.CLEANUP, None) == setting
    assert sorted(r["id"] for r in rows.collect()) == list(range(100))


def test_keys_that_share_their_leading_bits_are_sorted():
    close = [(5 << 60) + n for n in (3, 1, 2, 1, 0)]
    for made in (close, [*close, 7, 2**63], [2**63, *close], [4] * 5, [2**64 - 1, 0, 2**64 - 1]):
        for n in range(len(made) + 1):
            keys = np.array(made[:n], np.uint64)
            order, found = lm.in_order(keys)
            assert order.tolist() == np.argsort(keys, kind="stable").tolist() and found.tolist() == sorted(made[:n])
            known, rank = lm.ranked(keys)
            assert known[rank].tolist() == made[:n] and known.tolist() == sorted({*made[:n]})


def test_scoring_without_training_rows(spark):
    rows = frame(spark, [(1, "a b", None, None, 0), (None, None, None, None, 0)])
    assert {r["base_score"] for r in lm.score(rows, F.lit(True)).collect()} == {0.0}
    assert lm.score(rows.limit(0), F.lit(False)).count() == 0


def library():
    return Tokenizer.from_file(TOKENIZER)


def sample_texts():
    rng = random.Random(9)
    letters = "aaab ththe  in\n\t ésß日🙂\x85\xa0 123 's 'll!!!<|endoftext|>"
    return [t or "" for t in HARD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(500)]


def test_prefix_encoder_equals_the_library():
    texts, encoder, fast = sample_texts(), bpe.PrefixEncoder(TOKENIZER), tokens.FastEncoder(TOKENIZER)
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(encoder(t), np.int32).tolist() for t in texts] == want
    assert [fast(t).tolist() for t in texts] == want
    decoder = bpe.Decoder(TOKENIZER)
    assert [decoder(ids) for ids in want] == texts
    assert all(encoder.whole(i) for i in encoder.ids.values())


def test_encode_and_decode_frames(spark):
    texts = [*HARD, "repeat", "repeat"]
    rows = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "a.b")
    found = {r["doc_id"]: r for r in bpe.decode(bpe.encode(rows, TOKENIZER), TOKENIZER).collect()}
    assert {i: r["decoded"] for i, r in found.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip_digests(rows.limit(0), TOKENIZER).count() == 0


def check_pieces(rows, pieces, capacity=1024):
    tokenizer = library()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[i])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return 1 - sum(map(len, ids.values())) / (capacity * len(by_sequence))


def test_packing_holds_every_id_once_with_little_padding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10**6 + i, t) for i, t in enumerate(HARD)]
    found = packing.pack(frame(spark, [(i, t, None, None, 0) for i, t in rows]).coalesce(1), TOKENIZER).collect()
    assert check_pieces(rows, found) < 0.02
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_differencing_is_near_equal_and_windows_rise():
    rng = random.Random(6)
    sizes = [rng.randint(1, 256) for _ in range(600)]
    split = packing.difference(sizes, 80)
    assert sorted(i for w in split for i in w) == list(range(600))
    sums = [sum(sizes[i] for i in w) for w in split]
    assert max(sums) - min(sums) <= 0.02 * max(sums)
    assert len(packing.windows_of([600, 600, 600], 1024)) == 3
    assert packing.windows_of([]) == []
    assert public_tokenizers.path("byte_bpe_50k.json") == TOKENIZER
