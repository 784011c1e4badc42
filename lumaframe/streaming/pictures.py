"""Pictures from a folder of streams as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumaframe.operators.decode import decode_pictures
from lumaframe.sources.annexb import nal_units


def arriving_streams(spark: SparkSession, folder: str) -> DataFrame:
    """stream_id and content of each file that arrives in ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(folder).select(F.col("path").alias("stream_id"), "content")


def write_pictures(streams: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Decode each batch of files to Parquet below ``table``, one folder a batch, which a repeated batch overwrites.

    A file is a whole stream, so no state crosses batches.
    """

    def batch(part: DataFrame, number: int) -> None:
        decode_pictures(nal_units(part)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return streams.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
