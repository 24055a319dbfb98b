"""Articles as a stream: JSON files as they arrive, repeated deliveries dropped, frames scored, counts per window of time.

All Column builders are stateless and run on streams as they are; state is only kept for dropping repeats and for windows, and
the watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from framelens.functions import text as X
from framelens.operators.detect import Detector, detect
from framelens.sources.articles import ARTICLE_SCHEMA

STREAM_SCHEMA = T.StructType([*ARTICLE_SCHEMA.fields, T.StructField("ingested_at", T.TimestampType())])


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines of articles with ingested_at, file by file."""
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_deliveries(articles: DataFrame, late: str = "1 day") -> DataFrame:
    """Each article once: repeats that come within the watermark are dropped."""
    return articles.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["article_id"])


def scored(articles: DataFrame, detector: Detector) -> DataFrame:
    """articles with cleaned text, groups mentioned and a prediction."""
    cleaned = articles.withColumn("cleaned_content", X.clean_text(F.col("content")))
    return detect(cleaned.withColumn("demographics_found", F.map_keys(X.demographics(F.col("cleaned_content")))), detector, "cleaned_content")


def frame_counts(scored_articles: DataFrame, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, end, source, frame, n): articles with each frame by window of arrival. Needs a watermark on ingested_at."""
    each = scored_articles.select("ingested_at", "source", F.explode("prediction.frames").alias("frame"))
    w = F.window("ingested_at", window, slide) if slide else F.window("ingested_at", window)
    return each.groupBy(w.alias("w"), "source", "frame").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "source", "frame", "n")


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends to a Parquet folder; ``once`` takes what is there and stops."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
