"""Score review files as they arrive.

``score_rows_stream``: ``readStream`` over a folder of review files (parquet or
CSV) -> row-wise scoring (``rowwise``) -> a plain file sink: no ``foreachBatch``,
no state, input columns kept and the text column resolved by name as in batch.
Models beyond the broadcast bounds score each micro-batch with joins instead and
write it to a ``_row_batch=`` folder of its own.

``score_stream``, for models of any size: ``readStream`` ->
``foreachBatch`` -> the same ``score_prepared`` plan as batch scoring ->
parquet appended under ``out_path``. ``foreachBatch`` is used because Naive
Bayes scoring aggregates per document, which on a bare stream would need state;
each micro-batch is complete in itself, so no watermark or state is needed.
The query's checkpoint gives exactly-once file bookkeeping; a micro-batch that
is replayed after a failure rewrites its own ``batch_id`` folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rowwise import RowScorer, score_rows, score_rows_by_joins
from ..operators.scoring import ModelBundle, prepare, score_prepared
from ..sources.reviews import CSV_OPTIONS, mark_missing


def review_stream(spark: SparkSession, in_path: str, schema, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Files under the folder ``in_path`` (optionally only names matching ``glob``).
    CSV is read with the options and missing-value markers of ``read_csv_reviews``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return mark_missing(reader.load(in_path)) if fmt == "csv" else reader.load(in_path)


def score_stream(stream: DataFrame, models: ModelBundle, out_path: str, checkpoint: str,
                 text: str = "text", key: str = "doc_id", available_now: bool = True,
                 processing_time: str | None = None) -> StreamingQuery:
    def score_batch(batch: DataFrame, batch_id: int) -> None:
        std = batch.select(key, F.coalesce(F.col(text).cast("string"), F.lit("nan")).alias("text"))
        # one checkpointed, doc_id-partitioned copy of the batch feeds all three models
        prepared = prepare(std, "text", key)
        scored = score_prepared(prepared, models, key).withColumn("batch_id", F.lit(batch_id))
        scored.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def score_rows_stream(stream: DataFrame, models: ModelBundle | RowScorer, out_path: str, checkpoint: str,
                      text: str | None = None, available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Every input row with its score columns, appended as parquet under ``out_path``."""
    scorer = models if isinstance(models, RowScorer) else RowScorer.of(models)
    if scorer is None:
        def score_batch(batch: DataFrame, batch_id: int) -> None:
            score_rows_by_joins(batch, models, text).write.mode("overwrite").parquet(f"{out_path}/_row_batch={batch_id}")

        writer = stream.writeStream.foreachBatch(score_batch)
    else:
        writer = score_rows(stream, scorer, text).writeStream.format("parquet").option("path", out_path)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
