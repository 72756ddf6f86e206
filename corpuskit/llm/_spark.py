"""Session helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast if its rows and their bytes, both counted, are at most these.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names. Only a local session that names none gets one of this machine; a cluster's is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="corpuskit-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether df has at most so many rows, of at most so many bytes as JSON; it counts no further than these rows."""
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n <= rows and (held or 0) <= size


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is counted to be small; a shuffle join otherwise."""
    return F.broadcast(df) if small(df) else df


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df has it (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
