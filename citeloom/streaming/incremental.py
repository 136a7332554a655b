"""Works that arrive over time, merged into a library.  Beyond what a batch needs: a file stream with one
merge for each micro-batch, so that new files are picked up exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from citeloom.sources.works_json import WORKS_SCHEMA, to_papers
from citeloom.store import Store


def works_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(WORKS_SCHEMA).option("multiLine", True).json(folder)


def merge_into(store: Store, works: DataFrame, checkpoint: str, **options) -> StreamingQuery:
    """Start merging; a batch that is repeated after a failure changes nothing, since merging twice is merging once."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.persist(to_papers(batch, **options))

    return works.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
