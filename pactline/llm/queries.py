"""The registered queries of the operators: thin digests over whole tables. None is expressible in SQL but operators 3 and
12, so the others are tested against brute force, round trips and held-out accuracy in `tests/llm`."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm import byte_bpe, chat, gam, language_id, merkle, packing, repetition, sharding, simhash, topk, warc, whitening, word_table
from pactline.llm.common import crc_part, tune

N_SHARDS = 24
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`id, label` of the labelled documents."""
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_part("doc_id", 4) == 2, F.lit(False))
    found = language_id.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.fingerprinted(_table(spark, sf_dir, "documents"))
    found = simhash.near_duplicates(rows)
    return found.select(F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    log = chat.events_of_turns(turns.unionByName(extra))
    formatted = chat.render(chat.final_messages(log))
    back = formatted.withColumns({
        "turns": chat.turns_of(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans")),
    })
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, replace(replace(text, '~', '~0'), '<|', '~1') AS body,
    replace(replace(replace(role, '~', '~0'), '<|', '~1'), chr(10), '~2') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def op4_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    laid = sharding.write_shards(docs, "doc_id", [1.0] * N_SHARDS)
    raw = F.coalesce("text", F.lit(""))
    return laid.select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.train(docs, quality_labels(spark, sf_dir), crc_part("id", 5) != 0)
    held_out = F.coalesce(crc_part("doc_id", 5) == 0, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), gam.score(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents").select("doc_id", byte_bpe.encode(F.col("text"), *rank_file).alias("ids"))
    found = docs.withColumn("decoded", byte_bpe.decode(F.col("ids"), *rank_file))
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repetition.judged(docs).select("doc_id", "rules.*")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("words_8").alias("n_repeat_words"), "base_failed", "kept"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = warc.read_archives(spark, path)
    own = F.col("record_type") == "response"
    return found.select(
        warc.id_of(F.col("record_id")).alias("page_id"),
        F.when(own, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"), "record_type",
        warc.id_of(F.col("refers_to")).alias("refers_to"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = merkle.leaf_hash([F.col(c) for c in docs.columns])
    without_breaks = F.when(crc_part("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = merkle.leaf_hash([*(F.col(c) for c in docs.columns[:-1]), without_breaks])
    return merkle.manifest(docs, leaf, tampered).withColumnRenamed("id", "doc_id")


#: The tree level by level; crc32 from its bits, as the engine has none.
OP12_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
marked AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce(xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 2 = 0, FALSE) AS even FROM documents, tab),
said AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
    CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS shown FROM marked),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS shown FROM said),
lv AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, n FROM lv
  UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
sib AS (
  SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM up a JOIN up b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
su AS (SELECT tree AS own, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM su
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM up2 WHERE n > 1 GROUP BY lvl, pos // 3, n),
sib2 AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM up2 a JOIN up2 b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
walk AS (
  SELECT rid, tree, 0 AS lvl, pos, n, shown AS d, '' AS p FROM lv
  UNION ALL SELECT rid, w.tree, w.lvl + 1, w.pos // 3, (w.n + 2) // 3, sha256(l || d || r), p || l || r
  FROM walk w JOIN sib s ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos = w.pos WHERE w.n > 1),
walk2 AS (
  SELECT rid, 0 AS lvl, su.pos, su.n, d, p FROM walk w JOIN su ON su.own = w.tree WHERE w.n = 1
  UNION ALL SELECT rid, w.lvl + 1, w.pos // 3, (w.n + 2) // 3, sha256(l || d || r), p || l || r
  FROM walk2 w JOIN sib2 s ON s.lvl = w.lvl AND s.pos = w.pos WHERE w.n > 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, d AS folded_root, d = h AS verified
FROM lv JOIN su ON su.own = lv.tree JOIN walk2 USING (rid), (SELECT h FROM up2 WHERE n = 1) top WHERE walk2.n = 1
"""


def op13_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = word_table.encode(_table(spark, sf_dir, "documents"), path).withColumn("decoded", word_table.decode(F.col("ids"), path))
    return found.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_simhash, op3_chat, op4_rendezvous, op5_packing, op6_gam, op7_top_k, op8_byte_bpe, op9_quality_rules, op10_warc,
        op11_whitening, op12_merkle, op13_word_table,
    )
}
ORACLE: dict[str, str] = {"op3_chat": OP3_SQL, "op12_merkle": OP12_SQL}
