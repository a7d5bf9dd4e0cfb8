"""The registered queries of the text operators, and reference SQL where there is some."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.llm import (
    alignment, exact_dedup, hard_negatives, language_model, licences, ngram_join, packing, quality, records,
    sentence_pieces, substring, toxicity, warc,
)
from gritsieve.llm.common import read


#: The documents as a tree of files: a directory for a thousand and for a hundred ids of a
#: source, with some of the documents as its licence files.
PATH = """concat(source, '/', doc_id div 1000, '/', CASE WHEN doc_id % 500 = 0 THEN 'LICENSE'
  WHEN doc_id % 25 = 0 THEN concat(doc_id div 100, '/LICENSE') ELSE concat(doc_id div 100, '/', doc_id, '.txt') END)"""


def op1_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.language_model(read(spark, folder, "documents"))


def op2_records(spark: SparkSession, folder: str) -> DataFrame:
    manifest = records.write_records(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    return records.read_digests(manifest)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 2048)


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    forest = quality.fit(docs, read(spark, folder, "labels"))
    return quality.judge(docs, forest).select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, folder, "documents"), keep="largest")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, folder, "labels")))


def op7_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring.passages(read(spark, folder, "documents"))


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_groups(read(spark, folder, "documents"), width=3, percent=90)


def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    files = read(spark, folder, "documents").selectExpr("doc_id", "text", f"{PATH} AS path")
    return licences.licences(files)


def op10_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_pieces.digests(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives.hard_negatives(read(spark, folder, "embeddings").withColumn("label", moved))


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_digests(warc.write_archives(read(spark, folder, "pages")))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.digests(
        read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_model, op2_records, op3_packing, op4_quality, op5_exact_dedup, op6_toxicity,
        op7_substring, op8_ngram_join, op9_licences, op10_sentence_pieces,
        op11_hard_negatives, op12_warc, op13_alignment,
    )
}

ORACLES = {
    "op5_exact_dedup": """
        WITH plain AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
          doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM plain WINDOW w AS (PARTITION BY t)
    """,
    "op8_ngram_join": r"""
        WITH RECURSIVE split AS (
          SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
          FROM split),
        sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
        flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
        common AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY ALL),
        links AS (
          SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * common.n >= 90 * (x.n + y.n - common.n)),
        pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
          SELECT a AS node, a AS seen FROM pairs UNION SELECT r.node, e.b FROM reach r JOIN pairs e ON e.a = r.seen)
        SELECT s.doc_id, s.n AS n_shingles, coalesce(min(r.seen), s.doc_id) AS component_id
        FROM sizes s LEFT JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n
    """,
    "op11_hard_negatives": """
        WITH base AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
          SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
            list_dot_product(a.v, b.v)::BIGINT AS score
          FROM base a JOIN base b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
          SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, p.positive_id,
          CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
          s.other AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
          AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        QUALIFY rank <= 10
    """,
    "op12_warc": """
        WITH plain AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
          FROM pages),
        firsts AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM plain)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM firsts
    """,
}
