"""Tasks whose size follows the input's, whatever number of shuffle partitions a session is set to."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files for which a task is made. Columnar files unfold to some thirty times their size as sorted rows.
TASK_BYTES = 2 << 20


def file_bytes(*dfs: DataFrame) -> int:
    """Bytes of the files that data frames read, a file as often as it is read; what isn't read from files counts as nothing."""
    total = 0
    for df in dfs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for n in range(leaves.size()):
            if leaves.apply(n).getClass().getSimpleName() == "LogicalRelation":
                total += int(leaves.apply(n).stats().sizeInBytes())
    return total


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None, task_bytes: int | None = None, always: bool = False) -> DataFrame:
    """df dealt out by keys over a task for each task_bytes (TASK_BYTES) of its files (or those of `like`).

    Where the session makes as many shuffle partitions, df stays as it is, or is dealt out over that many if `always`:
    for few rows of which many are made, as a shuffle that Spark itself plans would go by their bytes.
    """
    n = -(-file_bytes(df if like is None else like) // (task_bytes or TASK_BYTES))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, usual), *keys) if always or n > usual else df
