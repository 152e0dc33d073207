"""One best version of every document: exact copies, then versions of the same stem.

Both rules are a minimum per key and a join back, so a key with very many files is summed in the tasks that
read them and its join can be split; no key's files meet in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import naming


def exact_duplicates(files: DataFrame) -> DataFrame:
    """``files (path, sha256, ...)`` with ``first_path``: the first path of the same content, in order of path parts.

    Files without a hash (unreadable ones) are each their own first.
    """
    first = files.where("sha256 is not null").groupBy("sha256").agg(
        F.min(F.struct(naming.path_parts(F.col("path")).alias("parts"), F.col("path"))).alias("least")
    )
    joined = files.join(first.select("sha256", F.col("least.path").alias("first_path")), "sha256", "left")
    return joined.withColumn("first_path", F.coalesce("first_path", "path"))


def versions(files: DataFrame) -> DataFrame:
    """Files that are no exact copies, with ``stem`` and the ``best_path`` of the stem over all folders.

    Best: by extension, a scan with text before one without, the shorter path, then the order of path parts.
    """
    name = naming.filename(F.col("path"))
    kept = exact_duplicates(files).where("path = first_path").withColumn("stem", naming.canonical_stem(name))
    rank = F.struct(
        naming.extension_rank(naming.extension(name)).alias("e"), F.when(naming.is_ocr(name), 0).otherwise(1).alias("o"),
        F.length("path").alias("l"), naming.path_parts(F.col("path")).alias("p"), F.col("path"),
    )
    best = kept.groupBy("stem").agg(F.min(rank).alias("best")).select("stem", F.col("best.path").alias("best_path"))
    return kept.join(best, "stem")


def best_versions(files: DataFrame) -> DataFrame:
    return versions(files).where("path = best_path").drop("best_path", "first_path")


def skip_log(files: DataFrame) -> DataFrame:
    """``path, reason, winner`` of every file that is not processed."""
    copies = exact_duplicates(files).where("path != first_path").select("path", F.lit("exact_duplicate").alias("reason"), F.col("first_path").alias("winner"))
    older = versions(files).where("path != best_path").select("path", F.lit("superseded_by_better_version").alias("reason"), F.col("best_path").alias("winner"))
    return copies.unionByName(older)
