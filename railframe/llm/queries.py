"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, idfiles, manifest, neardup, negatives, neighbours, packing, pieces, pii, quality, secrets, warc
from .common import saved

#: The tokenizers file that packing and id files use.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The SentencePiece model that segmentation uses, and how many segmentations of each text.
PIECE_MODEL, SEGMENTATIONS = public_tokenizers.path("piece_bpe_32k.model"), 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op2_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.checked_revisits(warc.read_archives(archives)).drop("url")


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.secrets(docs))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmented(table(spark, sf_dir, "documents"), PIECE_MODEL, SEGMENTATIONS)


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = idfiles.write_ids(table(spark, sf_dir, "documents"), TOKENIZER, end_id=1)
    return idfiles.read_ids(files)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.read_back(saved(chat.formatted(turns.unionByName(more)), "chats")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), every=100, positives=5, negatives=5, low=80, label=label)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proofs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_block_neighbours": op2_block_neighbours,
    "op3_warc": op3_warc,
    "op4_compression_quality": op4_compression_quality,
    "op5_minhash_near_duplicates": op5_minhash_near_duplicates,
    "op6_secret_scan": op6_secret_scan,
    "op7_personal_data": op7_personal_data,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_sentencepiece_nbest": op9_sentencepiece_nbest,
    "op10_token_id_files": op10_token_id_files,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Queries that SQL can express. The others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op2_block_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
    """,
    "op11_chat_formatting": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), n AS (
            SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w, role || '-') <> role AS opens,
                   length(list_reduce(list_prepend(replace(text, chr(92), chr(92) || chr(92)), control), lambda s, x: replace(s, x, x[1] || chr(92) || x[2:]))) AS chars,
                   length(list_reduce(list_prepend(replace(role, chr(92), chr(92) || chr(92)), control), lambda s, x: replace(s, x, x[1] || chr(92) || x[2:]))) AS role_chars
            FROM t, (SELECT ['<s>', '</s>', '<|turn|>', '<|text|>', '<|next|>', '<|end|>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|im_start|>', '<|im_end|>', '<|endoftext|>'] AS control)
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (7 + sum(chars + CASE WHEN opens THEN 8 + role_chars + 8 + 7 ELSE 8 END))::BIGINT AS formatted_chars
        FROM n GROUP BY conv_id
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
            WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same
        ), w AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, c.vec_id AS negative_id, c.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY c.score DESC, c.vec_id) AS n
            FROM p JOIN s c ON c.anchor_id = p.anchor_id AND NOT c.same AND 80 * p.score <= 100 * c.score AND 100 * c.score <= 100 * p.score
            WHERE p.n <= 5
        )
        SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE n <= 5
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, text, row_number() OVER () AS id,
                   coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
                   || coalesce(octet_length(encode(source)) || ':' || source, '-')
                   || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
                   || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
                   xor(list_reduce(
                       list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))
                   ), 4294967295) % 5 = 0 AS tampered
            FROM documents
        ), leaves AS (
            SELECT id, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                   CASE WHEN tampered THEN sha256(head || coalesce(octet_length(encode(small)) || ':' || small, '-')) END AS other
            FROM d
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM leaves
        ), low(level, source, place, h, total) AS (
            SELECT 0, source, place, leaf, total FROM placed
            UNION ALL
            SELECT level + 1, source, place // 16, sha256(string_agg(h, '' ORDER BY place)), (total + 15) // 16
            FROM low WHERE total > 1 GROUP BY level, source, place // 16, total
        ), tops AS (
            SELECT source AS member, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM low WHERE total = 1
        ), high(level, place, h, total) AS (
            SELECT 1000, place, h, total FROM tops
            UNION ALL
            SELECT level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (total + 15) // 16
            FROM high WHERE total > 1 GROUP BY level, place // 16, total
        ), way(id, level, source, place, total) AS (
            SELECT p.id, 0, p.source, p.place, p.total FROM placed p
            UNION ALL
            SELECT id, level + 1, source, place // 16, (total + 15) // 16 FROM way WHERE total > 1
        ), over(id, level, place, total) AS (
            SELECT p.id, 1000, t.place, t.total FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.member
            UNION ALL
            SELECT id, level + 1, place // 16, (total + 15) // 16 FROM over WHERE total > 1
        ), sides AS (
            SELECT w.id, w.level, coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place < w.place), '') AS l, coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place > w.place), '') AS r
            FROM way w JOIN low n ON n.level = w.level AND n.source IS NOT DISTINCT FROM w.source AND n.place // 16 = w.place // 16
            WHERE w.total > 1 GROUP BY ALL
            UNION ALL
            SELECT w.id, w.level, coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place < w.place), ''), coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place > w.place), '')
            FROM over w JOIN high n ON n.level = w.level AND n.place // 16 = w.place // 16
            WHERE w.total > 1 GROUP BY ALL
        ), steps AS (
            SELECT id, string_agg(l || r, '' ORDER BY level) AS proof, list(struct_pack(l := l, r := r) ORDER BY level) AS path FROM sides GROUP BY id
        ), folded(id, h, path) AS (
            SELECT p.id, coalesce(p.other, p.leaf), coalesce(s.path, []) FROM placed p LEFT JOIN steps s ON p.id = s.id
            UNION ALL
            SELECT id, sha256(path[1].l || h || path[1].r), path[2:] FROM folded WHERE len(path) > 0
        )
        SELECT p.doc_id, p.leaf, t.h AS subroot, x.h AS root, sha256(coalesce(s.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = x.h AS verified
        FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.member JOIN folded f ON f.id = p.id AND len(f.path) = 0
        LEFT JOIN steps s ON s.id = p.id JOIN high x ON x.total = 1
    """,
}
