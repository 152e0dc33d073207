"""Re-identification risk: what is assessed, what came back, and its summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import sample_segments

FAILED = ("PARSE_ERROR", "ERROR")
#: The order of levels.
ORDER = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
RESPONSE = (
    "risk_level string, risk_summary string, quasi_identifiers array<struct<type:string,value:string,concern:string>>,"
    " reconstruction_path string, additional_redactions array<string>, recommendations array<string>, confidence double"
)


def prioritised(records: DataFrame, limit: int = 0) -> DataFrame:
    """Records with most review flags first, in file order among equals; ``limit`` 0 means all."""
    ordered = records.orderBy(F.desc(F.coalesce("metadata.review_flags", F.lit(0))), "line_no")
    return ordered.limit(limit) if limit else ordered


def prompts(records: DataFrame) -> DataFrame:
    return records.withColumn("sample", sample_segments(F.col("text")))


def parsed(responses: DataFrame, column: str = "response") -> DataFrame:
    """``assessment`` of a response in JSON, perhaps inside a code fence; else a row of level PARSE_ERROR with its start."""
    body = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    inner = F.when(F.startswith(body, F.lit("```")), F.regexp_replace(F.regexp_replace(body, r"(?s)^[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")).otherwise(body)
    got = F.from_json(inner, RESPONSE)
    ok = F.get_json_object(inner, "$").isNotNull() & got.isNotNull()
    return responses.withColumns(
        {
            "assessment": F.when(ok, got),
            "risk_level": F.when(ok, got["risk_level"]).otherwise("PARSE_ERROR"),
            "raw_response": F.when(~ok, F.substring(column, 1, 800)),
        }
    )


def assessed(records: DataFrame, assess: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``assess`` adds a column ``response`` to the records' samples: a model behind a service, or stored answers."""
    return parsed(assess(prompts(records)))


def distribution(assessments: DataFrame) -> DataFrame:
    return assessments.groupBy(F.coalesce("risk_level", F.lit("UNKNOWN")).alias("risk_level")).agg(F.count("*").alias("n"))


def highest(assessments: DataFrame) -> DataFrame:
    """One row; the first of the highest levels, a missing level counting as LOW, LOW where there is none."""
    rank = F.lit(0)
    level = F.coalesce("risk_level", F.lit("LOW"))
    for name, k in ORDER.items():
        rank = F.when(level == name, k).otherwise(rank)
    best = F.max_by(level, F.struct(rank.alias("r"), (-F.col("pos")).alias("p")))
    return assessments.agg(F.coalesce(best, F.lit("LOW")).alias("highest_risk_level"))


def report(assessments: DataFrame, total: int, model: str, stamp: str) -> DataFrame:
    """One row: when and by what it was made, how many records there are and were assessed, levels and the highest one."""
    levels = distribution(assessments).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_level", "n")))).alias("risk_distribution"))
    rows = assessments.agg(F.count("*").alias("records_assessed"))
    one = lambda df: df.withColumn("__k", F.lit(0))
    both = one(rows).join(one(levels), "__k").join(one(highest(assessments)), "__k").drop("__k")
    return both.select(F.lit(stamp).alias("generated_at"), F.lit(model).alias("model"), F.lit(total).cast("long").alias("total_records_in_dataset"), "*")


def to_retry(records: DataFrame, assessments: DataFrame) -> DataFrame:
    """The last record of every source whose assessment failed."""
    failed = assessments.where(F.col("risk_level").isin(*FAILED)).select("source").distinct()
    rows = records.withColumn("source", F.coalesce("metadata.source", F.lit(""))).join(failed, "source", "left_semi")
    return rows.groupBy("source").agg(F.max_by(F.struct("line_no", "text"), "line_no").alias("r")).select("source", "r.*")


def patched(assessments: DataFrame, again: DataFrame) -> DataFrame:
    """Of each source tried again, its first assessment takes the new level."""
    first = assessments.groupBy("source").agg(F.min("pos").alias("pos")).join(again.select("source", F.col("risk_level").alias("new_level")), "source")
    return assessments.join(first, ["source", "pos"], "left").withColumn("risk_level", F.coalesce("new_level", "risk_level")).drop("new_level")
