"""Streams into and out of an index: files that arrive become segments, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernal.operators import chunking
from quernal.plans.index import ATTEMPTS, SearchIndex
from quernal.plans.storage import scratch
from quernal.plans.store import Conflict

#: A version of a file: ``content`` is null where it is gone, the greatest ``at`` of a path is the one that counts.
SCHEMA = "file_path string, language string, content string, at bigint"


def apply(batch: DataFrame, home: str, name: str, number: int, **more) -> SearchIndex | None:
    """Bring an index up by one batch of file versions (:data:`SCHEMA`), as number ``number`` of stream ``name``.

    The commit keeps the number, so a batch that is run again after a failure finds itself done; one that loses to another
    writer of the same files begins anew from what that has committed.
    """
    spark = batch.sparkSession
    for attempt in range(ATTEMPTS):
        index = SearchIndex.open(spark, home, **more)
        if index and index.commit.batches.get(name, -1) >= number:
            return index
        last = batch.groupBy("file_path").agg(F.max_by(F.struct("language", "content"), "at").alias("f")).select("file_path", "f.*")
        last = scratch(last)
        chunks = scratch(chunking.chunk_files(last.where("content is not null")))
        # a version without text leaves no chunks: its file goes as if it were deleted
        gone = last.select("file_path").join(chunks.select("file_path").distinct(), "file_path", "left_anti")
        try:
            if index:
                return index.upsert(chunks, gone, (name, number))
            return None if chunks.isEmpty() else SearchIndex.of_chunks(chunks, home=home, batch=(name, number), **more)
        except Conflict:
            if attempt + 1 == ATTEMPTS:
                raise
    raise AssertionError


def follow(versions: DataFrame, home: str, name: str, checkpoint: str, **more) -> StreamingQuery:
    """Run a stream of file versions (:data:`SCHEMA`) into the index in ``home`` until what is there is in."""
    return versions.writeStream.foreachBatch(lambda batch, number: apply(batch, home, name, number, **more)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """JSON files of file versions that arrive in a folder, as a stream of at most so many files a batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", most).json(folder)
