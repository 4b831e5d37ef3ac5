"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leakage, mixing, neighbours, origin, scans, syntax
from . import sentences as sent

TOKENIZER = os.environ.get("LODESTRATA_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")  # of these queries
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows in enough partitions for Python work, where a table came in few files."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


_NFKC = "lower(nfc_normalize(replace(replace(replace({0}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')))"  # what of NFKC the passages need; DuckDB has NFC only
_GRAMS = "SELECT {1}, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT {1}, list_filter(regexp_split_to_array(" + _NFKC + ", '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM {2}), range(1, greatest(len(ws) - 11, 1)) t(i) WHERE len(ws) >= 13"


@query("WITH d AS (" + _GRAMS.format("text", "doc_id", "documents") + "), e AS (" + _GRAMS.format("passage", "item_id", "eval_items") + ") SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spread(spark, table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items")).where("n_literal > 0").select("doc_id", "item_id")


@query()
def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    """All leaks, with re-parameterised ones."""
    return leakage.leaks(spread(spark, table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


@query()
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(spread(spark, table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_targets"), TOKENIZER)[0]


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(spread(spark, table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_targets"), TOKENIZER)[1]


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sent.sentences(spread(spark, table(spark, d, "documents").select("doc_id", "text")))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "block_vectors").where("first_row = 0 and last_row = 0").select("block_id", F.col("vector").alias("v"))
    return spread(spark, v)


@query("""WITH r AS (SELECT DISTINCT block_id, vector FROM block_vectors WHERE first_row = 0 AND last_row = 0 AND block_id IS NOT NULL AND len(vector) = 64
   AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
 s AS (SELECT a.block_id AS a, b.block_id AS b, max(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[])) AS c FROM r a JOIN r b ON a.block_id <> b.block_id GROUP BY 1, 2),
 t AS (SELECT a, b, c FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10)
 SELECT DISTINCT least(a, b) AS block_a, greatest(a, b) AS block_b FROM t WHERE c >= 0.9""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    n = neighbours.neighbours(_whole(spark, d), "block_id", "v", 64, 10, floor=0.90)
    return n.select(F.least("block_id", "near").alias("block_a"), F.greatest("block_id", "near").alias("block_b")).distinct()


@query()
def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(_whole(spark, d), "block_id", "v", 64, 10)


@query()
def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the 10 nearest, for every block whose id is divisible by 100, against all rows ranked exactly."""
    return neighbours.recall(_whole(spark, d), "block_id", "v", 64, 10)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, table(spark, d, "code_files").select("file_id", "codebase_id", "language", "path", "content"))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_errors(_files(spark, d)).where("error is not null").select("file_id").distinct()


@query()
def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Files that do not parse, and their rate, per codebase and language as written."""
    e = syntax.syntax_errors(_files(spark, d), keep=("codebase_id", "language"))
    return e.groupBy("codebase_id", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count("error").alias("n_errors"), F.round(F.count("error") / F.count(F.lit(1)), 6).alias("error_rate"))


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.origins(_files(spark, d)).select("file_id").distinct()


@query()
def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return origin.origins(_files(spark, d))


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(spread(spark, table(spark, d, "blocks")), table(spark, d, "documents"))["found"]


@query()
def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every document's blocks as continuous, repaired paragraphs."""
    return scans.paragraphs(scans.repair(spread(spark, table(spark, d, "blocks")), table(spark, d, "documents")))
