"""Streaming queries over the events table, each beside the batch SQL it must equal, and file ingest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as src
from ..streaming import events as ev
from ..session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ev.event_stream(spark, os.path.join(d, "events.parquet"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ev.drain(ev.tumbling(_events(spark, d)))


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ev.drain(ev.sliding(_events(spark, d)))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
 SELECT min(ts) AS start, user_id, count(*) AS n FROM k GROUP BY user_id, sid""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ev.drain(ev.sessions(_events(spark, d)))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    return ev.drain(ev.deduplicate(_events(spark, d)).select("event_id", "event_type"), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "ts", "event_id", "event_type", "value")
    return ev.upsert_stream(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("WITH a AS (SELECT DISTINCT ON (doc_id) * FROM documents), k AS (SELECT sha256 FROM a WHERE doc_id % 2 = 0) SELECT sha256, min(doc_id) AS doc_id FROM a WHERE sha256 IS NOT NULL AND sha256 NOT IN (SELECT sha256 FROM k WHERE sha256 IS NOT NULL) GROUP BY 1")
def ingest_new_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content is not known, the smallest id per content; the known half are the even ids."""
    a = table(spark, d, "documents").select("doc_id", "sha256").distinct()
    return ev.ingest_new(a.where("doc_id % 2 = 0"), a, "sha256", "doc_id").select("sha256", "doc_id")


@query("SELECT collection_id, count(DISTINCT pin_key) AS n FROM pins GROUP BY 1")
def markdown_collections(spark: SparkSession, d: str) -> DataFrame:
    m = src.collection_markdown(table(spark, d, "pins"))
    return m.select("collection_id", F.size(F.split("markdown", "\n\n---\n\n")).cast("long").alias("n"))
