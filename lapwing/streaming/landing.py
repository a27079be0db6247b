"""Incremental landing with exactly-once keys."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lapwing.operators.quality import keep_first
from lapwing.sources.ledger import Ledger, new_rows


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name kept beside the checkpoint: batch numbers start anew if that is lost, and then so does the name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{checkpoint.rstrip('/')}/stream-name")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, False)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    return spark.read.text(path.toString()).first()[0]


def land_batch(rows: DataFrame, ledger: Ledger, stream: str, batch: int, keys: Sequence[str], partitions: Sequence[str], order: Sequence[Column]) -> bool:
    """Lands the keys of one batch that haven't landed, the first row of each in ``order``; False if the batch had been.

    The rows and the batch's mark become visible together, so a batch that failed half way is simply repeated.
    """
    state = ledger.state()
    if state.marks.get(stream, -1) >= batch:
        return False
    fresh = new_rows(keep_first(rows, list(keys), list(order)), ledger.table(state), keys, partitions)
    folder = ledger.stage(fresh, f"{stream}-{batch}", partitions)
    ledger.publish(state, rows, [folder], {stream: batch})
    return True


def land_stream(
    rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partitions: Sequence[str], order: Sequence[Column]
) -> StreamingQuery:
    """Appends new keys to the ledger table at ``path``, then stops.

    No state is kept in the stream: keys are compared with the table's own partitions that a batch touches, so a repeat is
    dropped however late it comes, after a lost checkpoint too.  A key always has to come with the same partition values.
    """
    spark = rows.sparkSession
    ledger, stream = Ledger(spark, path), _stream_name(spark, checkpoint)
    return (
        rows.writeStream.foreachBatch(lambda df, batch: land_batch(df, ledger, stream, batch, keys, partitions, order) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
