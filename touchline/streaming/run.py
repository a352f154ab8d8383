"""Running a stream to the end of its input, with sink and checkpoint in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.session import shared_folder, spread, width


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def in_batches(df: DataFrame, name: str, *keys: str, batches: int = 3) -> DataFrame:
    """A stream of a frame's rows in several micro-batches; rows with equal keys come in one of them."""
    place = new_place(df.sparkSession, name)
    spread(df, *keys).write.parquet(place)
    some = -(-width(df.sparkSession) // batches)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", some).parquet(place)


def drain(stream: DataFrame, name: str, place: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Append the stream to a table, a folder per value of `by`, until its input is used up, and read the table.

    With a `place` of an earlier run the stream goes on from that run's checkpoint.
    """
    spark = stream.sparkSession
    place = place or new_place(spark, name)
    q = (stream.writeStream.format("parquet").option("path", f"{place}/data").option("checkpointLocation", f"{place}/checkpoint")
         .partitionBy(*by).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/data")


def drain_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hand every micro-batch to a function until the input is used up."""
    place = new_place(stream.sparkSession, name)
    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{place}/checkpoint").outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
