"""Skills that arrive as a stream: each micro-batch is analysed, and a skill whose digest is known already is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.analyze import Options, analyze


def ingest(files: DataFrame, table: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """files: a stream of whole skills (skill_id, dir, path, content); appends to the Parquet table."""

    def batch(df: DataFrame, batch_id: int) -> None:
        found = analyze(df.dropDuplicates(["skill_id", "path"]), options).dropDuplicates(["skill_id", "digest"])
        spark = df.sparkSession
        try:
            known = spark.read.parquet(table).select("skill_id", "digest").join(df.select("skill_id").distinct(), "skill_id", "left_semi")
            found = found.join(known, ["skill_id", "digest"], "left_anti").select(found.columns)
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
        found.write.mode("append").parquet(table)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
