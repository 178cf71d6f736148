"""Claims and events as streams: the batch aggregates, kept up to date as rows arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions.clean import gene, known_year, polarity
from claimweave.session import shared_folder


def read_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The files of a table as a stream, with the schema of those that are there now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    probe = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = probe.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(probe).isFile()
    reader = spark.readStream.schema(schema).options(**options)
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)


def batch_counts(stream: DataFrame) -> DataFrame:
    """Claims and positives per interaction and year, as a running aggregate."""
    c = stream.select(gene("up").alias("up"), gene("dn").alias("dn"), known_year().alias("year"), polarity().cast("int").alias("pos")).dropna()
    return c.groupBy("up", "dn", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("k"))


def windows(stream: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    """Events per tumbling window and type. Rows of windows that the watermark has passed are dropped, so
    state is kept for open windows only."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def drain(agg: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream over what has arrived and give its result as a table in the shared folder: in update
    mode, each micro-batch writes the groups it changed, and the last state of each group counts."""
    spark = agg.sparkSession
    base = f"{shared_folder(spark)}/claimweave/{uuid.uuid4().hex}"

    def keep(df: DataFrame, epoch: int) -> None:
        # A batch that is repeated after a failure overwrites its own folder.
        df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
    q = agg.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    fields = T.StructType([*agg.schema.fields, T.StructField("epoch", T.LongType())])
    out = spark.read.schema(fields).parquet(f"{base}/out")
    rest = [c for c in agg.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("__cw_s")).select(*keys, "__cw_s.*").select(*agg.columns)


def batch_counts_of(spark: SparkSession, path: str) -> DataFrame:
    return drain(batch_counts(read_stream(spark, path)), ["up", "dn", "year"])


def event_windows(spark: SparkSession, path: str, width: str, late: str = "1 day", **options: str) -> DataFrame:
    s = read_stream(spark, path, **options).withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    return drain(windows(s, width, late), ["window", "event_type"]).select(F.col("window.start").alias("start"), "event_type", "n")
