"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pactline.llm import (
    byte_bpe, chat, gam, language_id, merkle, packing, repetition, sharding, shingles, simhash, topk, warc, whitening, word_table,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard_ int, fp string, id string, value string"
LONG = " ".join(f"w{i * i % 997} x{i}" for i in range(30_000))
TEXTS = ["", None, " \n\t", "one", "a b c", "The same words here and there " * 3, "€ 日本 \U0001f600 \x00 \x85 x", "a" * 5000, LONG, LONG]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 2 else None, None, None, 1, "f", "i", "v") for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None, 1, "f", "i", "v"), (3, "one", "en", None, None, 1, "f", "i", "v"), (3, "other text of that id", "en", None, None, 1, "f", "i", "v")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_language(docs, none):
    rows = language_id.identify(docs, F.lit(True)).collect()
    assert len(rows) == docs.count() and {r["lang_pred"] for r in rows} == {"en", "und"}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert {r["lang_pred"] for r in language_id.identify(docs, F.lit(False)).collect()} == {"und"}
    assert language_id.identify(none, F.lit(True)).count() == 0


def test_probabilities_add_up(spark):
    model = language_id.fit(spark.createDataFrame([("en", "banana bandana"), ("en", "ban the can")], "lang string, text string"))
    context = language_id.grams(["ban"])[0][-1] & np.uint64((1 << 48) - 1)
    following = (context << np.uint64(16)) | np.arange(32, 4128, dtype=np.uint64)
    assert np.exp2(-language_id.information(model, "en", following)).sum() == pytest.approx(1, abs=0.02)


def test_every_gram_has_its_own_entry(spark):
    """Many distinct grams: none is lost or answers for another."""
    rng = random.Random(2)
    texts = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)) for _ in range(1000)]
    model = language_id.fit(spark.createDataFrame([("zz", t) for t in texts], "lang string, text string"))
    gram = np.unique(language_id.grams(texts)[0])
    assert len(gram) > 300_000 and (model["zz"][4, 0][0] == gram).all()
    other = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)) for _ in range(100)]
    unseen = np.setdiff1d(language_id.grams(other)[0], gram)
    assert len(unseen) > 30_000 and not np.isin(unseen, model["zz"][4, 0][0]).any()
    assert (language_id._lookup(model["zz"][4, 0], unseen, 0.0) == 0).all()


def test_simhash(docs, none):
    rows = simhash.near_duplicates(simhash.fingerprinted(docs)).collect()
    assert len(rows) == docs.count()
    by_id = {r["id"]: r for r in rows if r["id"] is not None and r["id"] != 3}
    assert [by_id[i]["component_id"] for i in (0, 1, 2, 8, 9)] == [0, 0, 0, 8, 8] and by_id[0]["fp"] == 0
    assert [r["component_id"] for r in rows if r["id"] is None] == [None]
    assert simhash.near_duplicates(simhash.fingerprinted(none)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, (r["text"] or "")[:5]) for r in kept.collect()) == sorted(
        [(-1, "no id"), (0, ""), (3, "one"), (3, "other"), (4, "a b c"), (5, "The s"), (6, "€ 日本 "), (7, "aaaaa"), (8, LONG[:5])]
    )
    assert simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 4, 7])
@pytest.mark.parametrize("small", [0, 10**9])
def test_bit_slices_equal_brute_force(radius, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_GROUP", small)
    rng = random.Random(radius)
    for n in (1, 2, 63, 64, 65, 300):
        base = [rng.getrandbits(64) for _ in range(4)]
        fps = list({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(n)})
        zero = np.zeros(len(fps), int)
        a, b = (x.view(np.uint64).tolist() for x in simhash.linked(np.array(fps, np.uint64), zero, zero, radius))
        parent = {x: x for x in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a, b, strict=True):
            p, q = sorted((root(x), root(y)))
            parent[q] = p
        want = brute.components(fps, radius)
        assert {x: want[root(x)] for x in fps} == want
        assert len({root(x) for x in fps}) == len(set(want.values()))


def test_parts_of_hot_fields_lose_no_link(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(400)})
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(nodes, 4, part_rows=50)).collect()}
    found = {}
    for x in fps:
        s = x - (1 << 64) if x >> 63 else x
        found.setdefault(labels.get(s, s), set()).add(x)
    want = {}
    for x, label in brute.components(fps).items():
        want.setdefault(label, set()).add(x)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_chat_folds_events(spark):
    log = spark.createDataFrame(
        [
            (1, 1, 1, "delta", "user", "Hi "), (1, 1, 2, "delta", None, "<|im_end|>~1"), (1, 2, 3, "delta", "assistant", "draft"),
            (1, 2, 4, "regenerate", None, None), (1, 2, 5, "delta", None, "an"), (1, 2, 6, "delta", None, "swer"), (1, 3, 7, "delta", "user", "gone"),
            (1, 3, 8, "delete", None, None), (1, 4, 9, "delta", "us\ner~2", "old"), (1, 4, 10, "edit", None, "new"), (1, 4, 11, "delta", None, "er"),
            (None, 1, 1, "delta", None, None), (2, 1, 1, "delta", "user", "x"), (2, 1, 2, "delete", None, None),
        ],
        "conv_id long, message long, seq long, kind string, role string, text string",
    )
    out = chat.render(chat.final_messages(log.withColumn("turns", F.lit(1))))
    rows = {r["conv_id"]: r for r in out.select("*", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert {k: [tuple(t) for t in r["t"]] for k, r in rows.items()} == {
        1: [("user", "Hi <|im_end|>~1"), ("assistant", "answer"), ("us\ner~2", "newer")], None: [("", "")],
    }
    assert rows[1]["l"] == "answer" and rows[None]["l"] == ""
    assert chat.render(chat.final_messages(log.limit(0))).count() == 0


def test_chat_escapes_are_reversible(spark):
    parts = ["~", "0", "1", "2", "<|", "<", "|", "im_start|>", "<|im_end|>\n", "\n", "é\U0001f600"]
    rng = random.Random(3)
    rows = [(i, 1, rng.choice(["user", "assistant"]), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.final_messages(chat.events_of_turns(turns)))
    back = out.select("conv_id", chat.turns_of(F.col("formatted"))[0].alias("t")).collect()
    assert {r["conv_id"]: tuple(r["t"]) for r in back} == {i: (role, text) for i, _, role, text in rows}


def test_shards(docs, none):
    laid = sharding.write_shards(docs, "doc_id", [1.0, 2.0, 1.0])
    rows = laid.collect()
    assert len(rows) == docs.count() and set(docs.columns) < set(laid.columns)
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert sharding.write_shards(none, "doc_id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), "doc_id", [1.0])


def test_shards_follow_weights_and_grow_alone(spark):
    ids = spark.range(40_000).select(
        sharding.assign(F.col("id"), [1.0, 3.0]).alias("a"), sharding.assign(F.col("id"), [1.0, 3.0, 2.0]).alias("b")
    ).groupBy("a", "b").count().collect()
    moved = {(r["a"], r["b"]): r["count"] for r in ids}
    assert set(moved) <= {(0, 0), (1, 1), (0, 2), (1, 2)}
    assert sum(n for (_, b), n in moved.items() if b == 2) == pytest.approx(40_000 / 3, rel=0.05)
    assert sum(n for (a, _), n in moved.items() if a == 1) == pytest.approx(30_000, rel=0.05)


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.packed(docs, path).collect()
    per = {}
    for r in rows:
        per.setdefault(r["sequence_id"], []).append(r["length"])
        assert len(r["ids"]) == 4 * r["length"]
    assert max(map(sum, per.values())) <= 4096
    want = sum(map(len, brute.word_ids([r["text"] for r in docs.select("text").collect()])))
    assert sum(r["length"] for r in rows) == want
    assert packing.packed(none, path).count() == 0


def test_ids_are_the_library_s():
    rng = random.Random(12)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "hello", "World", " ", "\n", "é", "'s", "3", "endoftext", "日本", "\xa0", "."]
    texts = ["hello <|endoftext|> world", *["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]]
    words = packing.load(public_tokenizers.path("word_bpe_49k.json"))
    for text, want in zip(texts, brute.word_ids(texts), strict=True):
        assert np.frombuffer(words.encode(text, 2), "<u4").tolist() == want, text


@pytest.mark.parametrize("sizes", [[], [4096], [1] * 5000, [4095, 2, 4095, 2], [3000] * 7, list(range(1, 300))])
def test_windows_hold_the_capacity(sizes):
    sizes = np.array(sizes, np.int64)
    window = packing.windows(sizes, 4096)
    assert len(window) == len(sizes)
    if len(sizes):
        assert np.bincount(window, sizes).max() <= 4096


def test_classifier(docs, none):
    labels = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).cast("int").alias("label"))
    for known in (labels, labels.limit(0), labels.withColumn("label", F.lit(1)), labels.withColumn("label", F.lit(None).cast("int"))):
        model = gam.train(docs, known, F.lit(True))
        scores = [r["s"] for r in docs.select(gam.score(F.col("text"), model).alias("s")).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert none.select(gam.score(F.col("text"), model).alias("s")).count() == 0
    assert gam.keep_good(docs, labels, F.lit(True)).columns == docs.columns


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_top_k(spark):
    rows = [(i, [random.Random(i).uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(100)] + [(20, [0.5] * 8), (40, [0.5] * 8), (40, [0.5] * 8)]
    rows += [(60, None), (80, [None] * 8), (100, [float("nan")] + [0.0] * 7), (120, [float("inf")] * 8), (None, [0.1] * 8), (140, []), (160, [1.0])]
    df = spark.createDataFrame([(*r, "s") for r in rows], "vec_id long, embedding array<float>, score string")
    found = topk.top_k(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    rows = [(i, [np.float32(x) if x is not None else None for x in v] if v is not None else None) for i, v in rows]
    assert sorted(map(tuple, found)) == brute.top_k(rows)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert topk.top_k(few, F.col("vec_id") == 0).count() == 2


def test_levels_hold_all_postings():
    vectors = np.random.default_rng(1).integers(-50, 50, (500, 16))
    index = topk.Index(np.arange(500), vectors)
    assert (sum(part for part, _ in index.levels()) == vectors).all()
    highest = [np.abs(part).max() for part, _ in index.levels()]
    assert highest == sorted(highest, reverse=True) and [below for _, below in index.levels()][:-1] == highest[1:]


def test_byte_bpe(docs):
    rank_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    bpe = byte_bpe.load(*rank_file)
    rng = random.Random(5)
    parts = ["a", "aa", " ", "  ", "\n", "é", "ñ", "!", "1", "日本", "́", "'s", "the", "ß", "\U0001f600", "\t", "\x85", "\xa0", ""]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 80))) for _ in range(500)] + ["a" * 3000, "ab" * 2000, "日" * 900, " " * 999, None]
    for text, (n, ids, raw) in zip(texts, brute.bpe(texts), strict=True):
        packed = bpe.encode(text)
        assert (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(packed)).hexdigest()) == (n, ids, raw)
    found = docs.select(byte_bpe.encode(F.col("text"), *rank_file).alias("i")).select(byte_bpe.decode(F.col("i"), *rank_file).alias("d")).collect()
    assert sorted(bytes(r["d"]) for r in found) == sorted((r["text"] or "").encode() for r in docs.collect())


def test_every_token_is_its_own_encoding():
    """What the proof of `join` rests on."""
    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert all(bpe._merged(token) == (rank,) for token, rank in list(bpe.ranks.items())[::7])


def test_quality_rules(docs, none):
    clash = docs.withColumnRenamed("fp", "rules0")
    kept = repetition.keep_good(clash)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {8, 9}
    assert repetition.keep_good(none).count() == 0


def test_equal_hashes_of_different_windows():
    ids, doc, at = np.array([1, 2, 3, 1, 2, 4]), np.zeros(6, int), np.arange(5)
    same = repetition._repeated(np.zeros(5, np.uint64), at, 2, ids, doc)
    assert sorted(set(same.tolist())) == [0, 3]


def test_warc(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    same = "x" * 1500
    rows = [(1, "http://a\r\nX: y", same), (2, None, same), (3, "u", fake * 30), (4, "u", None), (5, "u", ""), (None, "u", same), (6, "u", fake)]
    rows += [(7, "u", "WARC/1.1\r\n"), (8, "u", fake * 40 + "é" * 3000), (9, "u", fake * 30), (11, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n")]
    rows += [(100 + i, "u", fake * (i % 7) + str(i)) for i in range(60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").coalesce(2)
    want = brute.pages([(r[0], r[2]) for r in rows])
    expected = sorted((-1 if i is None else i, want[i][2], want[i][3] or -1, (h or "") if want[i][2] == "response" else None) for i, _, h in rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for kind, block in (("none", "3000"), ("gzip", old)):  # blocks that end inside records, and one block a file
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            found = warc.read_archives(spark, warc.write_archives(df, compression=kind))
            found = found.select(warc.id_of(F.col("record_id")).alias("i"), "record_type", warc.id_of(F.col("refers_to")).alias("r"), "payload").collect()
            got = [(-1 if r["i"] is None else r["i"], r["record_type"], r["r"] or -1, None if r["payload"] is None else bytes(r["payload"]).decode()) for r in found]
            assert sorted(got, key=str) == sorted(expected, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0


def test_stages_keep_columns_and_survive_odd_rows(spark, docs, none, tmp_path):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == frame.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count()


def test_components_of_a_large_star_and_chains(spark):
    star = [(7, 1000 + i) for i in range(4000)]
    chain = [(20_000 + i, 20_001 + i) for i in range(40)]
    pair = [(-9, 5), (-9, -9)]
    found = simhash.components(spark.createDataFrame(star + chain + pair, "a long, b long"))
    want = {b: 7 for _, b in star} | {b: 20_000 for _, b in chain} | {5: -9}
    assert {r["node"]: r["label"] for r in found.collect() if r["node"] != r["label"]} == want


def near_copies():
    """Texts that share a passage, chains of near copies about the threshold, pairs right at it, and odd rows."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [word() for _ in range(30)]
    texts = ["", None, "One", "one", "a b c d", "a b c d e", " ".join(common), "\n"]
    for n in (20, 60, 150, 400):
        for _ in range(6):
            base = [word() for _ in range(n)] + common[: rng.randint(0, 30)]
            for _ in range(5):
                texts.append(" ".join(base))
                base = list(base)
                for _ in range(rng.randint(0, 1 + n // 60)):
                    base[rng.randrange(len(base))] = word()
    # 84 words are 80 shingles: another 20 are a similarity of 0.8, another 21 are less
    for more in (20, 21):
        base = [word() for _ in range(84)]
        texts += [" ".join(base), " ".join(base + [word() for _ in range(more)])]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("batch", [10, 50_000])
def test_near_dedup_keeps_one_of_each_group_of_similar_texts(spark, tmp_path, monkeypatch, batch):
    monkeypatch.setattr(shingles, "BATCH_ROWS", batch)
    monkeypatch.setattr(shingles, "SAMPLE", 2)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(brute.similar(rows).values())
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()} == want
    by_fingerprint = {c for _, c in brute.simhash(rows).values()}
    assert len(by_fingerprint) > len(want)


def test_near_dedup_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute.similar([tuple(r) for r in docs.orderBy("doc_id").collect()])
    assert sorted(r["doc_id"] for r in shingles.keep_one(docs).collect()) == sorted(set(want.values()))


def test_near_dedup_takes_candidates_of_operator_2(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, 0b1111), (4, 0b111111), (5, 1 << 40 | 0xFFFF0000), (6, -1)], "fp long, print long")
    pairs = {tuple(sorted(r)) for r in shingles.by_fingerprint(rows).collect()}
    assert len(pairs) == 3 and (1, 2) in pairs and {n for p in pairs for n in p} == {1, 2, 3, 4}
    assert shingles.by_fingerprint(rows.limit(0)).collect() == []
    asked, found = [], shingles.by_fingerprint
    monkeypatch.setattr(shingles, "by_fingerprint", lambda rows: asked.append(1) or found(rows))
    words = [f"w{i}" for i in range(90)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:89])), (3, "other"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()} == {1, 3, 4}
    assert asked


def test_bit_maps_exclude_no_similar_sets():
    rng = np.random.default_rng(4)
    excluded = 0
    for n in (1, 5, 9, 100, 1000, 5000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random() * 0.5 + 0.5], rng.integers(0, 2**63, n // 9).astype(np.uint64)]))
            common = len(np.intersect1d(x, y))
            possible = shingles.may_be_similar(len(x), shingles.bit_map(x), len(y), shingles.bit_map(y))
            assert possible or 5 * common < 4 * len(np.union1d(x, y))
            excluded += not possible
    assert excluded > 50


def test_near_dedup_compares_parts_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(shingles, "PART_ROWS", 3)
    df = spark.createDataFrame([(i, t, "k", "h") for i, t in near_copies()], "doc_id long, text string, _key string, _hash string")
    kept = shingles.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r)[::2] for r in kept.collect()) == sorted((i, "k") for i in set(brute.similar(near_copies()).values()))


def vectors():
    """Dimensions of very different spread, two of equal spread, one constant."""
    rng = np.random.default_rng(3)
    made = (rng.standard_normal((400, 12)) * [3, 3, 1, 0.5, 0.5, 0.2, 0.1, 0.05, 0.01, 0.01, 0.001, 0] + 0.3).tolist()
    return [(i, v) for i, v in enumerate(made)]


KINDS = "vec_id long, embedding array<double>, deviation string, k int, id string"


def test_whitening(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, vectors()[0][1]), (7, vectors()[0][1]), (8, None), (9, [1.0, None]), (10, [nan]), (11, [-inf]), (12, []), (13, [2.0, -1.0])]
    rows = vectors() + odd
    df = spark.createDataFrame([(*r, "d", 1, "i") for r in rows], KINDS).repartition(5)
    found = whitening.whiten(df).collect()
    got = sorted((-1 if r["id"] is None else r["id"], r["component"], r["n"], r["deviation"], r["explained"]) for r in found)
    want = sorted((-1 if i is None else i, *r[:3], r[4]) for i, *r in brute.whitening(rows))
    assert [g[:4] for g in got] == [w[:4] for w in want] and len({r["n"] for r in found}) == 1
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9)
    z = np.array([r["whitened"] for r in sorted(found, key=lambda r: (r["id"] is None, r["id"], r["component"], r["whitened"])) if r["id"] not in (None, 7)])
    assert abs(z).max() < 50 and found[0]["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame([(*r, "d", 1, "i") for r in rows], KINDS))

    empty = run([])
    assert empty.count() == 0 and empty.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert run([(1, None), (2, [])]).count() == run([(1, [0.5, 1.0])] * 5).count() == 0
    one = sorted(tuple(r) for r in run([(1, [0.0]), (2, [1.0])]).collect())
    assert [(r[0], r[1], r[2], r[3], abs(r[4]), r[5]) for r in one] == [(1, 1, 2, 1 << 20, 1, 1), (2, 1, 2, 1 << 20, 1, 1)]
    big = run([(i, [float(i % 3) * 1e4, float(i % 5)]) for i in range(30)]).collect()
    assert len(big) == 60 and big[0]["identity_error"] < 1e-6
    with pytest.raises(Exception, match="beyond 64 bits"):
        run([(1, [1e300]), (2, [0.0])]).collect()


def test_sums_of_products_stay_whole(spark):
    """Entries whose products a double doesn't hold."""
    rng = np.random.default_rng(4)
    values = rng.integers(-(1 << 40), 1 << 40, (60, 3))
    df = spark.createDataFrame([(v.tolist(),) for v in values / 1024], "vector array<double>").repartition(3)
    got = whitening.covariance(df, whitening.centre(df))
    n, sums = len(values), [sum(int(x) for x in c) for c in values.T]
    for i in range(3):
        for j in range(3):
            exact = sum((n * int(a) - sums[i]) * (n * int(b) - sums[j]) for a, b in zip(values[:, i], values[:, j], strict=True)) / n**3
            assert got[i, j] == exact


@pytest.mark.parametrize("case", ["random", "equal", "blocks", "diagonal", "rank", "zero", "one", "graded"])
def test_eigenvectors(case):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((40, 40))
    q, _ = np.linalg.qr(a)
    spread = {
        "random": a @ a.T, "equal": q @ np.diag([5.0] * 6 + [1.0] * 34) @ q.T, "blocks": np.kron(np.eye(10), np.array([[2, 1, 0, 0], [1, 2, 0, 0], [0, 0, 3, 1], [0, 0, 1, 3]])),
        "diagonal": np.diag(np.arange(40.0)), "rank": a[:, :3] @ a[:, :3].T, "zero": np.zeros((4, 4)), "one": np.array([[7.0]]),
        "graded": q @ np.diag(10.0 ** -np.arange(40)) @ q.T,
    }[case]
    values, found = whitening.components(spread, 8)
    want = np.linalg.eigvalsh((spread + spread.T) / 2)[::-1][:8]
    size = max(abs(want).max(), 1e-300)
    assert np.allclose(values, want, rtol=0, atol=1e-13 * size)
    assert np.abs(found @ found.T - np.eye(len(found))).max() < 1e-12
    assert np.abs(spread @ found.T - found.T * values).max() <= 1e-12 * size


LEAVES = "doc_id long, text string, lang string, source string, n_chars long, tree string, at int, digest string"


def manifest_rows():
    rng = random.Random(8)
    rows = [(i, f"t{i}\n{'x' * (i % 9)}" if i % 7 else None, rng.choice(["en", None, ""]), "hot" if i % 3 else f"s{i % 40}", i) for i in range(1500)]
    rows += [(None, "a\nb", "en", "hot", None), (5, "another of that id\n", "en", "hot", 1), (5, "another of that id\n", "en", "hot", 1)]
    rows += [(2000, "lone", "en", "alone", 1), (2001, "no source\n", None, None, 2), (2003, "", "", "", 0), (2004, "€\n", "é", "😀", 3), (2005, LONG, "en", "￿", 4)]
    return rows


def manifest(df, **more):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(df, merkle.leaf_hash([*fields, F.col("text")]), merkle.leaf_hash([*fields, tampered]), **more)
    return sorted(((r["id"] is not None, r["id"] or 0), *r) for r in found.collect())


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest(spark, levels):
    """Blocks of one level are many rounds, those of five two."""
    rows = manifest_rows() if levels > 1 else manifest_rows()[-120:]
    df = spark.createDataFrame([(i, t, lang, s, n, "t", 1, "d") for i, t, lang, s, n in rows], LEAVES).repartition(6)
    want = brute.merkle([(i, s, lang, n, t) for i, t, lang, s, n in rows])
    assert manifest(df, levels=levels) == sorted(((r[0] is not None, r[0] or 0), *r) for r in want)


def test_manifest_of_little(spark):
    def run(rows):
        return manifest(spark.createDataFrame([(*r, "t", 1, "d") for r in rows], LEAVES))

    assert run([]) == []
    ((_, i, leaf, subroot, root, proof, back, good),) = run([(1, "x", None, None, None)])
    assert i == 1 and leaf == subroot == root == back and good and proof == hashlib.sha256(b"").hexdigest()
    same = run([(4, "x", "en", "s", 1)] * 10)
    assert len(same) == 10 and len({r[2] for r in same}) == 1 and all(r[-1] for r in same)


def test_sweeps_equal_the_tree():
    rng = random.Random(9)
    for total in [1, 2, 3, 4, 9, 10, 28, 81, 100, 243]:
        digests = [merkle.digest_of([str(rng.random())]) for _ in range(total)]
        ways, top = brute._levels(digests)
        found, received = merkle.forward(0, digests, total)
        assert found == top
        assert [list(w) for w in merkle.backward(0, total, total, received, ())] == ways


BPE_50K = public_tokenizers.path("byte_bpe_50k.json")


def word_texts():
    rng = random.Random(6)
    parts = ["a", "aa", " ", "  ", "\n", "é", "ñ", "!", "1", "日本", "́", "'s", "'S", "the", "ß", "😀", "\t", "\x85", "\xa0", " ", "\x1c", "<|endoftext|>", "<|", "՘", "𲎰", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)]
    return texts + ["a" * 30_000, "日" * 9000, " " * 5000, "<|endoftext|>" * 3, LONG, LONG, "", None, " \n\t"]


@pytest.mark.parametrize("limits", [(40_000, 4_000_000, 4000), (5, 50, 2)])
def test_word_table(spark, tmp_path, limits):
    texts = word_texts() if limits[0] > 5 else word_texts()[:300]
    rows = [(i, t, 1, "w", b"") for i, t in enumerate(texts)] + [(None, "no id", 1, "w", b""), (0, texts[0], 1, "w", b"")]
    spark.createDataFrame(rows, "doc_id long, text string, k int, word string, ids binary").repartition(3).write.parquet(f"{tmp_path}/docs")
    found = word_table.encode(spark.read.parquet(f"{tmp_path}/docs"), BPE_50K, most=limits)
    found = found.withColumn("text", word_table.decode(F.col("ids"), BPE_50K)).collect()
    assert len(found) == len(rows)
    want = list(brute.byte_words(texts))
    for r in found:
        if r["id"] is not None:
            got = len(r["ids"]) // 4, hashlib.sha256(bytes(r["ids"])).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()
            assert got == want[r["id"]] and r["text"] == (texts[r["id"]] or "")
    assert word_table.encode(spark.read.parquet(f"{tmp_path}/docs").limit(0), BPE_50K).count() == 0


def test_pieces_are_the_library_s():
    """Every plane's code points, among letters, numbers, spaces and marks."""
    words = word_table.load(BPE_50K)
    rng = random.Random(7)
    for cp in [*range(0x600), *rng.sample(range(0x600, 0xD800), 6000), *rng.sample(range(0xE000, 0x110000), 3000)]:
        text = f"a{chr(cp)}a1{chr(cp)}1 {chr(cp)}{chr(cp)} {chr(cp)}!"
        assert words.pieces_of(text) == [text[a:b] for _, (a, b) in words.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_decoding_of_single_ids(spark):
    def packed(*ids):
        return np.array(ids, "<u4").tobytes()

    rows = [(packed(50256, 0),), (packed(),), (None,), (packed(220, 220),), (packed(*range(188, 200)),)]
    got = [r[0] for r in spark.createDataFrame(rows, "ids binary").coalesce(1).select(word_table.decode(F.col("ids"), BPE_50K)).collect()]
    library = word_table.load(BPE_50K).tokenizer
    assert got == ["<|endoftext|>!", "", "", "  ", library.decode(list(range(188, 200)), skip_special_tokens=False)]
    with pytest.raises(Exception, match="outside the vocabulary"):
        spark.createDataFrame([(packed(50257),)], "ids binary").select(word_table.decode(F.col("ids"), BPE_50K)).collect()
