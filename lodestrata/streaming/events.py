"""Streams: windows over event time with watermarks, de-duplication, latest-per-key upserts, exactly-once file ingest.

Each function takes a streaming or a batch DataFrame of the same columns; batch results are what the stream's final state
must equal. ``drain`` runs a streaming query over what is there and gives its result as a table in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a parquet file or folder, with the files' own schema."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    g = e.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def deduplicate(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """First row per key. In a stream the state is bounded by the watermark."""
    if events.isStreaming:
        return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def _done(spark, root: str) -> list[int]:
    """Numbers of the batches below ``root`` that were written whole."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def drain(df: DataFrame, mode: str = "complete", name: str | None = None) -> DataFrame:
    """Run a stream over everything that is there. Every batch writes its own folder of the shared folder, so a batch that is
    run again replaces its own part only; in complete mode the last whole batch is the result, else all of them are. A stream
    without output gives an empty table. A stream with a ``name`` goes on where it stopped."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/streams/{name or uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    whole = _done(spark, f"{root}/out")
    if not whole:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{root}/out/batch={n}" for n in (whole[-1:] if mode == "complete" else whole)])


def upsert(state: DataFrame | None, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row per key of a kept state and a batch; ties in ``order`` go to the larger row. Running a batch twice
    changes nothing."""
    u = batch if state is None else state.unionByName(batch)
    rest = [c for c in u.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order, *[F.col(c).cast("string") for c in rest if c not in order]))
    return u.groupBy(*key).agg(best.alias("m")).select(*key, "m.*")


BUCKETS = 64  # parts of a kept state; a micro-batch rewrites those its keys fall into


def _state(spark, root: str, schema, before: int, only: list[int] | None = None) -> DataFrame | None:
    """The newest version of every bucket (or of ``only`` these) that whole batches below ``before`` have written."""
    newest: dict[int, str] = {}
    for n in _done(spark, root):
        if n < before:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch={n}/bucket=*")
            for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []:
                newest[int(f.getPath().getName().split("=")[1])] = str(f.getPath())
    paths = [p for b, p in sorted(newest.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def upsert_stream(events: DataFrame, key: list[str], order: list[str], name: str | None = None) -> DataFrame:
    """Latest row per key of a stream. The state is kept in ``BUCKETS`` parts by key; a micro-batch writes new versions of the
    parts it touches, under its own number. What is kept is found by listing the folder, so a stream with a ``name`` goes on
    after a restart, and a batch that is run again reads what was there before it."""
    spark = events.sparkSession
    root = f"{shared_dir(spark)}/streams/{name or uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, n: int) -> None:
        touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS at most
        new = upsert(_state(spark, f"{root}/state", batch.schema, n, touched), batch, key, order)
        new.select(*batch.columns, bucket.alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/state/batch={n}")

    q = events.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    kept = _state(spark, f"{root}/state", events.schema, 1 << 62)
    return spark.createDataFrame([], events.schema) if kept is None else kept


def ingest_new(known: DataFrame, arrived: DataFrame, content_hash: str = "sha256", order: str | None = None) -> DataFrame:
    """Arrived rows whose content is not known yet, one per content: the smallest by ``order``, if given."""
    new = arrived.where(F.col(content_hash).isNotNull()).join(known.select(content_hash), content_hash, "left_anti")
    if order is None:
        return new.dropDuplicates([content_hash])
    rest = [c for c in arrived.columns if c not in (content_hash, order)]
    return new.groupBy(content_hash).agg(F.min(F.struct(order, *rest)).alias("m")).select(content_hash, "m.*")
