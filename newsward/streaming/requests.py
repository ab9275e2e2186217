"""Requests handled as they arrive, in micro-batches of request files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from newsward.plans.jobs import JobResult
from newsward.session import shared_dir
from newsward.sources.mart import ParquetMart

REQUEST_SCHEMA = "request_id string, company_id string, company_name string, search_query string"


def watch_requests(
    spark: SparkSession,
    path: str,
    job: Callable[[DataFrame], JobResult],
    mart: ParquetMart,
    status_path: str,
    name: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Run ``job`` on each batch of new JSON-lines request files under ``path``.

    A batch that is repeated after a failure has the same number, hence the same
    load id and status folder, and replaces what it had written.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        load_id = f"{name}-{batch_id}"
        statuses = job(batch).run(mart, load_id)
        statuses.write.mode("overwrite").json(f"{status_path.rstrip('/')}/load_id={load_id}")

    stream = spark.readStream.schema(REQUEST_SCHEMA)
    requests = stream.option("maxFilesPerTrigger", files_per_batch).json(path)
    writer = requests.writeStream.foreachBatch(handle).queryName(name)
    progress = f"{shared_dir(spark).rstrip('/')}/progress/{name}"
    return writer.option("checkpointLocation", progress).trigger(availableNow=True).start()
