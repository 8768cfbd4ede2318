"""SimHash components, substring dedup and the star steps against brute force, with hard rows."""

import random

import numpy as np
import xxhash

from millwright.llm import components, simhash, substring

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts)], SCHEMA)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprint_matches_plain_computation():
    rng = random.Random(3)
    texts = ["", None, " \t\n", "One", "a B c", "x y z w", "é É \x85 a b c"] + [
        " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 300))) for _ in range(50)
    ]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_block_masks_cover_every_close_pair():
    rng = random.Random(5)
    for blocks in (5, 6, 7):
        masks = simhash.block_masks(blocks, 4)
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(60)) for _ in range(20)]
    texts = [None, "", "  ", "one two", "ONE two"] + base + [b + " tail" for b in base] + base[:5]
    for long in (base[0] * 200, base[0] * 200 + " end"):
        texts.append(long)
    found = {r["doc_id"]: r for r in simhash.simhash_report(docs(spark, texts)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(list(prints), prints, 4)
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}


def test_dense_bucket_gives_few_links():
    rng = random.Random(1)
    center = rng.getrandbits(64)
    points = {center}
    while len(points) < 400:
        points.add(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    links = simhash.forest(np.array(sorted(points), np.uint64), 4)
    assert len(links) == len(points) - 1


def test_dedup_handles_nulls_repeats_and_clashing_columns(spark):
    rows = docs(spark, ["same text here now", "same text here now", "other words entirely now", None, ""], [5, 2, 9, None, 9])
    rows = rows.withColumnRenamed("source", "fp").withColumnRenamed("lang", "component_id")
    kept = simhash.simhash_dedup(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (True, 2), (True, 9), (True, 9)]
    assert simhash.simhash_dedup(rows.limit(0)).count() == 0


def test_connected_components_on_a_long_path(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)]
    links = spark.createDataFrame(path, "a bigint, b bigint")
    found = {r["node"]: r["label"] for r in components.connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert components.connected_components(links.limit(0)).count() == 0


def plain_dedup(rows, min_words):
    """Rows (id, text) -> texts, by scanning documents in rank order."""
    first = {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for _, _, digest, _ in substring.units(text or ""):
            first.setdefault(digest, key)
    out = []
    for key, text in rows:
        taken = {d for _, _, d, _ in substring.units(text or "") if first[d] != key}
        out.append(None if text is None else substring.without(text, substring.repeated_spans(text, taken, min_words)))
    return out


PASSAGE = " ".join(f"word{i}" for i in range(30)) + ". Short one. " + " ".join(f"more{i}" for i in range(30)) + "."


def test_substring_dedup_matches_a_scan_and_keeps_offsets(spark):
    rng = random.Random(11)
    lines = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(12)) + "." for _ in range(30)]
    texts = ["\n".join(rng.sample(lines, 5)) for _ in range(40)] + [None, "", " \n ", "ok", "Hi. Hi. Hi.", lines[0] + "\n" + lines[0]]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    found = {r["doc_id"]: r for r in substring.substring_dedup(docs(spark, texts, ids)).collect()}
    assert {i: found[i]["text"] for i in ids} == dict(zip(ids, plain_dedup(rows, 8), strict=True))
    for i, t in rows:
        assert found[i]["text"] == (t and substring.without(t, [(s["start"], s["end"]) for s in found[i]["removed"]]))


def test_passages_go_whole_wherever_they_stand(spark):
    texts = ["Start here.\n" + PASSAGE + "\nThe end.", "Something else. " + PASSAGE + " And on it goes.", "Clean text that nobody else has."]
    found = {r["doc_id"]: r["text"] for r in substring.substring_dedup(docs(spark, texts)).collect()}
    assert found[0] == texts[0] and found[2] == texts[2]
    assert found[1] == "Something else. And on it goes."


def test_substring_dedup_with_null_and_repeated_ids(spark):
    texts = [PASSAGE, PASSAGE, PASSAGE, "x " * 40_000 + "."]
    rows = docs(spark, texts, [4, 4, None, 1]).withColumnRenamed("source", "removed")
    found = sorted((r["doc_id"] or 99, r["text"]) for r in substring.substring_dedup(rows).collect())
    assert found == [(1, texts[3]), (4, PASSAGE), (4, PASSAGE), (99, "")]
    assert substring.substring_dedup(rows.limit(0)).count() == 0


def test_substring_dedup_with_a_third_of_the_ids_null(spark):
    """Rows without an id share a rank but no list of hits; equal to a scan that takes each row by itself."""
    line = lambda k: f"line {k} holds quite enough words to be looked at on its own"
    texts = [(i if i % 3 else None, f"{line(i % 40)}\n{line(1000 + i)}\n{line(i % 7)}") for i in range(120)]
    first = {}
    for i, text in texts:
        for one in text.split("\n"):
            first[one] = min(first.get(one, 10**9), 10**9 if i is None else i)
    want = [(i or -1, "\n".join(x for x in dict.fromkeys(t.split("\n")) if first[x] == (10**9 if i is None else i))) for i, t in texts]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = [(r["doc_id"] or -1, "\n".join(x for x in r["text"].split("\n") if x)) for r in substring.substring_dedup(rows).collect()]
    assert sorted(found) == sorted(want)


def test_units_of_long_white_space():
    text = "a." + " " * 300_000 + "b" + "\t" * 300_000 + "c \n d"
    assert [text[a:b].split() for a, b, _, _ in substring.units(text)] == [["a."], ["b", "c"], ["d"]]


def test_unspaced_scripts_lose_repeated_sentences_and_lines(spark):
    shared = "これは三分の一の文書に写された長い段落の文であり空白がない。"
    thai = "ข้อความนี้ถูกคัดลอกไปยังเอกสารหลายฉบับโดยไม่มีช่องว่าง"
    texts = [
        "最初の文書だけにある文です。" + shared + "終わりの言葉が続く。",
        "別の文書の書き出しはこうです！" + shared + "結びは全く違うものになる。",
        thai + "\none",
        "two\n" + thai,
        "「今日は雨です。」と彼は言ったあとで長いあいだ黙っていた。",
    ]
    found = {r["doc_id"]: r["text"] for r in substring.substring_dedup(docs(spark, texts)).collect()}
    assert [found[i] for i in (0, 2, 4)] == [texts[0], texts[2], texts[4]]
    assert found[1] == "別の文書の書き出しはこうです！結びは全く違うものになる。" and found[3] == "two"
    assert [texts[4][a:b] for a, b, _, _ in substring.units(texts[4])] == ["「今日は雨です。」", "と彼は言ったあとで長いあいだ黙っていた。"]


def test_short_repeated_lines_go_and_short_sentences_stay(spark):
    texts = ["Share this\nOne story. Read more.", "Two stories. Read more.\nSHARE  this\nmore text", "Share this\nthree\nShare this", "Read more.\nfour"]
    found = {r["doc_id"]: r["text"] for r in substring.substring_dedup(docs(spark, texts)).collect()}
    assert found == {0: texts[0], 1: "Two stories. Read more.\nmore text", 2: "three", 3: texts[3]}
