"""Several documents as one input: discipline=path lists, and staged emission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def parsed_inputs(inputs: DataFrame) -> DataFrame:
    """inputs(..., input) with discipline, path and problem: malformed, or a discipline or path given twice."""
    form = r"^([^=]+)=(.+)$"
    rows = inputs.withColumns({"discipline": F.nullif(F.regexp_extract("input", form, 1), F.lit("")), "path": F.nullif(F.regexp_extract("input", form, 2), F.lit(""))})
    again = lambda c: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(f"n_{c}")).where(F.col(f"n_{c}") > 1)
    found = rows.join(again("discipline"), "discipline", "left").join(again("path"), "path", "left")
    problem = F.when(F.col("discipline").isNull(), "malformed").when(F.col("n_discipline").isNotNull(), "duplicate-discipline").when(F.col("n_path").isNotNull(), "duplicate-path")
    return found.select(*inputs.columns, "discipline", "path", problem.alias("problem"))


def staged(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Publish each micro-batch's trees, then one index row for each document that is complete in it (ST06, K06): readers
    that start from the index never see half a document. A batch that is run again writes the same folder."""

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/trees/batch={number}")
        done = batch.groupBy("document_id").agg(F.count(F.lit(1)).alias("entries"), F.max("last").alias("complete"))
        done.where("complete").select("document_id", "entries").write.mode("overwrite").parquet(f"{path}/index/batch={number}")

    return entries.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
