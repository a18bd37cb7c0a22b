"""The registered queries over whole small tables against brute force."""

import duckdb
import numpy as np
import pytest

from pactline.llm import queries
import brute

SF = "/root/testdata/sf0.001"


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def docs():
    return table("documents", "doc_id, text")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_language(spark):
    langs = dict(table("documents", "doc_id, lang"))
    rows = queries.op1_language_id(spark, SF).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in langs if brute.held(i, 4, 2)}
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_simhash(spark, docs):
    rows = by_id(queries.op2_simhash(spark, SF))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in rows.items()} == brute.simhash(docs)


def test_chat_equals_its_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(duckdb.sql(queries.OP3_SQL).fetchall()) == sorted(map(tuple, queries.op3_chat(spark, SF).collect()))


def test_shards(spark, docs):
    rows = queries.op4_rendezvous(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in docs]
    slots = {}
    for r in rows:
        assert r["grown_shard"] in (r["shard"], queries.N_SHARDS)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = by_id(queries.op4_rendezvous(spark, SF))
    assert {r["doc_id"]: r["shard"] for r in rows} == {i: r["shard"] for i, r in again.items()}


def test_packing(spark, docs):
    rows = [r.asDict() for r in queries.op5_packing(spark, SF).collect()]
    padding, fill = brute.check_pieces(rows, dict(docs))
    assert padding < 0.08 * 4096 * len(fill)


def test_quality_classifier(spark):
    labels = dict(table("labels", "doc_id, quality"))
    rows = by_id(queries.op6_gam(spark, SF))
    assert {i for i, r in rows.items() if r["held_out"]} == {i for i in rows if brute.held(i, 5, 0)}
    known = [(labels[i], r["predicted"]) for i, r in rows.items() if i in labels]
    assert np.mean([a == b for a, b in known]) > 0.9


def test_top_k(spark):
    found = queries.op7_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, found)) == brute.top_k(table("embeddings", "vec_id, embedding"))


def test_byte_bpe(spark, docs):
    rows = by_id(queries.op8_byte_bpe(spark, SF))
    for (i, _), want in zip(docs, brute.bpe([t for _, t in docs]), strict=True):
        assert tuple(rows[i][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_quality_rules(spark, docs):
    rows = by_id(queries.op9_quality_rules(spark, SF))
    for i, text in docs:
        r = rows[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.rules(text)
        assert not (r["base_failed"] and r["kept"])


def test_warc(spark):
    want = brute.pages(table("pages", "page_id, html"))
    rows = by_id(queries.op10_warc(spark, SF), "page_id")
    assert {i: tuple(r[c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) for i, r in rows.items()} == want


def test_whitening(spark):
    rows = queries.op11_whitening(spark, SF).collect()
    found = sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in rows)
    want = sorted(brute.whitening(table("embeddings", "vec_id, embedding")))
    assert [r[:4] for r in found] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in found], [r[4:] for r in want], rtol=1e-6, atol=1e-9)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_merkle(spark):
    columns = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    rows = queries.op12_merkle(spark, SF).select(*columns).collect()
    want = brute.merkle(table("documents", "doc_id, source, lang, n_chars, text"))
    assert sorted(map(tuple, rows)) == sorted(want)
    assert {r["verified"] for r in rows} == {True, False}


def test_word_table(spark, docs):
    rows = by_id(queries.op13_word_table(spark, SF))
    assert len(rows) == len(docs)
    for (i, _), want in zip(docs, brute.byte_words([t for _, t in docs]), strict=True):
        assert tuple(rows[i][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    names = [n for n, _ in p.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_dedup", "packing"]
    pieces = [r.asDict() for r in p.run(spark, SF).collect()]
    kept = {r["doc_id"] for r in pieces}
    brute.check_pieces(pieces, {i: t for i, t in docs if i in kept})
    component = {i: c for i, (_, c) in brute.simhash([d for d in docs if not brute.rules(d[1])[-1]]).items()}
    assert len({component[i] for i in kept}) == len(kept)
    good = dict(table("labels", "doc_id, quality"))
    assert not [i for i in kept if brute.rules(dict(docs)[i])[-1]]
    assert np.mean([good.get(i, 1) for i in kept]) > 0.97
