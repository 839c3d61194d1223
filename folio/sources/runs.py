"""Month-wise runs: each month is committed on its own, and a ledger says which months a run has done."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.catalog import write_months
from folio.sources.staging import scratch, staged

LEDGER = "run string, date string, ok boolean, fetched long, inserted long, updated long, error string"
#: Characters of an error that the ledger keeps.
ERROR_CHARS = 200


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and month: what was committed or, if nothing was, the last failure.  No rows where nothing was written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(f"{LEDGER}, at timestamp").parquet(path)
    last = F.max_by(F.struct("ok", "fetched", "inserted", "updated", "error"), F.struct("ok", "at")).alias("r")
    return rows.groupBy("run", "date").agg(last).select("run", "date", "r.*")


def _note(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, LEDGER).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def run_months(spark: SparkSession, run: str, months: Sequence[str], work: Callable[[list[str]], tuple[DataFrame, DataFrame]], store: str, ledger: str) -> DataFrame:
    """Does the months of a run that its ledger doesn't have yet, and returns the run's ledger.

    ``work(months)`` gives those months' new catalog rows and, by ``date``, their counts (any of fetched,
    inserted, updated).  Months are done together, in one plan; only where that fails are they halved,
    until the failing month stands alone, so the others are committed whatever it does.  A month's rows
    are computed and kept before its partition of the store is replaced, and the ledger is written last:
    a run that was broken off between the two does that month again, to the same end.
    """
    done = {r["date"] for r in read_ledger(spark, ledger).where((F.col("run") == run) & F.col("ok")).select("date").collect()}
    todo = [sorted(set(months) - done)]
    while todo:
        part = todo.pop()
        if not part:
            continue
        with scratch():
            try:
                rows, counts = work(part)
                rows, said = staged(rows, "months"), {r["date"]: r.asDict() for r in counts.collect()}
            except PySparkException as e:
                if len(part) > 1:
                    todo += [part[len(part) // 2 :], part[: len(part) // 2]]
                else:
                    _note(spark, ledger, [(run, part[0], False, None, None, None, str(e)[:ERROR_CHARS])])
                continue
            write_months(rows, store)
        _note(spark, ledger, [(run, m, True, *(int(said.get(m, {}).get(c) or 0) for c in ("fetched", "inserted", "updated")), None) for m in part])
    return read_ledger(spark, ledger).where(F.col("run") == run)
