"""The operators of this folder as queries over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_rank.llm.decontaminate import leaked_items
from feedback_rank.llm.fixity import audit, fixity, laid_out, warc_records
from feedback_rank.llm.hmm import score_documents
from feedback_rank.llm.jaccard import near_duplicates
from feedback_rank.llm.language import held_out, predict_language, train_language_model
from feedback_rank.llm.merge_replay import encoding_digests
from feedback_rank.llm.mixing import mixed_sizes
from feedback_rank.llm.negatives import hard_negatives, labelled_vectors
from feedback_rank.llm.quality import document_statistics, quality_scores, train_quality
from feedback_rank.llm.secrets import secret_digests
from feedback_rank.llm.token_files import read_tokens, write_tokens
from feedback_rank.llm.topk import top_products, whole_vectors
from feedback_rank.llm.variants import dented_words, spelling_variants
from feedback_rank.session import checkpointed, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    """The pattern that parts texts before the merges of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of all pages in their files, and a second copy of these files with faults.

    By page_id, one of 97 records has a byte changed, one of 101 is cut short, one of 103 is
    gone, and after one of 107 there is a stray byte. Each page is read and hashed once.
    """
    record, page = F.col("record"), F.col("page_id")
    half = F.floor(F.octet_length(record) / 2).cast("int")
    damaged = (
        F.when(page % 97 == 13, F.overlay(record, F.lit(b"\x00"), half)).when(page % 101 == 7, F.substring(record, 1, 40))
        .otherwise(record)
    )
    (length, digest), (their_length, their_digest) = fixity(record), fixity(damaged)
    rows = warc_records(pages).select(
        "file", "page_id", length.alias("length"), digest.alias("digest"), their_length.alias("their_length"), their_digest.alias("their_digest")
    )
    placed = checkpointed(laid_out(rows, ["page_id", "digest"]))
    theirs = placed.where(page.isNull() | (page % 103 != 5)).select(
        "file", "offset", F.col("their_length").alias("length"), F.col("their_digest").alias("digest")
    )
    stray = placed.where(page % 107 == 3).select(
        "file", (F.col("offset") + 1).alias("offset"), F.lit(1).cast("long").alias("length"), F.sha2(F.lit("x"), 256).alias("digest")
    )
    return placed.select("file", "offset", "length", "digest"), theirs.unionByName(stray)


@_query
def op1_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the faulty copy of all pages' records differs from the sound one."""
    return audit(*replicas(_table(spark, sf_dir, "pages")))


ORACLE_SQL["op1_fixity"] = """
WITH records AS (
  SELECT floor(page_id / 1000)::BIGINT AS file, page_id,
    strlen('WARC/1.1..WARC-Type: response..WARC-Record-ID: <urn:page:' || page_id || '>..WARC-Target-URI: ' || url
      || '..Content-Type: text/html..Content-Length: ' || strlen(html) || '....' || html || '....')::BIGINT AS length
  FROM pages
), placed AS (
  SELECT *, coalesce(sum(length) OVER (
    PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM records
)
SELECT file, "offset", CASE WHEN page_id % 103 = 5 THEN 'missing' ELSE 'changed' END AS status, length AS our_length,
  CASE WHEN page_id % 103 = 5 THEN NULL WHEN page_id % 97 = 13 THEN length WHEN page_id % 101 = 7 THEN 40 ELSE length END AS their_length
FROM placed WHERE page_id % 103 = 5 OR page_id % 97 = 13 OR page_id % 101 = 7
UNION ALL
SELECT file, "offset" + 1, 'extra', NULL, 1 FROM placed WHERE page_id % 107 = 3
"""


@_query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, in short."""
    return secret_digests(_table(spark, sf_dir, "documents"))


@_query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector, among all vectors."""
    vectors = whole_vectors(_table(spark, sf_dir, "embeddings"))
    return top_products(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL["op3_topk"] = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS point
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.point, v.point)::BIGINT AS score
  FROM valid q JOIN valid v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document among runs of four words that are alike to 85 percent."""
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=85)


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of four of five folds."""
    held = held_out(F.col("doc_id"), 5, 0)
    stats = checkpointed(document_statistics(_table(spark, sf_dir, "documents")))
    model = train_quality(stats, _table(spark, sf_dir, "labels").where(~held))
    return quality_scores(stats, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the items."""
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes of each."""
    return mixed_sizes(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@_query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written, and read back from the files."""
    path = scratch_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_tokens(spark, path, with_ids=False)


@_query
def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of six of seven folds."""
    docs, held = _table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2)
    scored = score_documents(docs, F.col("doc_id").isNotNull() & ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four folds."""
    docs, held = _table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    model = train_language_model(docs.where(F.col("doc_id").isNotNull() & ~held))
    return predict_language(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth vector and each of its five positives, the three best rows of other labels that are clearly less alike."""
    vectors = labelled_vectors(_table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", label)
    return hard_negatives(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL["op11_hard_negatives"] = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS point
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.point, v.point)::BIGINT AS score
  FROM valid a JOIN valid v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


@_query
def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as byte-level tokens, and decoded again, in digests."""
    return encoding_digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), word_pattern())


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent enough word of all documents with its neighbours, its form and its root."""
    return spelling_variants(dented_words(_table(spark, sf_dir, "documents")))
