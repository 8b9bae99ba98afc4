"""Event streams: tokens split over fragments are restored once a stream key's text is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reassemble(events: DataFrame) -> DataFrame:
    """doc_id (stream key) and text from stream_key, seq, fragment; keys with two fragments at one place are left out."""
    twice = events.groupBy("stream_key", "seq").count().where("count > 1").select("stream_key").distinct()
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("fragment", F.lit("")).alias("f")))), lambda x: x["f"]), "")
    return events.join(twice, "stream_key", "left_anti").groupBy("stream_key").agg(text.alias("text"))


def spread(events: DataFrame, restored: DataFrame) -> DataFrame:
    """Whole restored text in the first fragment, the rest empty; other keys as they were."""
    first = F.row_number().over(Window.partitionBy("stream_key").orderBy("seq")) == 1
    out = events.withColumn("__first", first).join(restored.select("stream_key", "restored"), "stream_key", "left")
    return out.withColumn("fragment", F.when(F.col("restored").isNull(), F.col("fragment")).when(F.col("__first"), F.col("restored")).otherwise("")).drop("__first", "restored")
