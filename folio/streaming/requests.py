"""JSON requests in a folder, answered by a checkpointed stream: each line once, also after a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folio.operators.flows import answers


def answer_requests(spark: SparkSession, requests: str, out: str, checkpoint: str, metadata: DataFrame | None = None, *, once: bool = True) -> StreamingQuery:
    """Answers the lines of the files in ``requests`` that the checkpoint doesn't have yet, into files in ``out``.

    With ``once`` it ends when what was there at its start is answered; otherwise it goes on.  The
    checkpoint and the sink's log make an answer appear once, wherever a run was broken off.
    ``metadata`` is a table of parsed files that answers may show.
    """
    said = answers(spark.readStream.format("text").load(requests), metadata)
    writer = said.writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
