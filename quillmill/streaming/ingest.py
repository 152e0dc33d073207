"""A folder of documents as a stream (an extension: the batch run's functions over files as they arrive)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.naming import EXTENSIONS, extension, filename
from quillmill.sources.files import decode_text

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_texts(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """New text files below a folder; a content seen within ``late`` is not taken twice."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).load(folder)
    named = files.withColumn("filename", filename(F.col("path"))).withColumn("ext", extension(F.col("filename")))
    known = named.where(F.col("ext").isin(*EXTENSIONS) & (F.col("ext") == ".txt"))
    texts = known.withColumn("raw", decode_text(F.col("content"))).withColumn("sha256", F.sha2("content", 256))
    return texts.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"]).drop("content")


def classify_into(stream: DataFrame, to: str, checkpoint: str):
    """Classified and cleaned documents appended as Parquet, exactly once per file."""
    from quillmill.operators.process import classified, cleaned

    done = cleaned(classified(stream.withColumn("ocr", F.lit(False))))
    return done.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
