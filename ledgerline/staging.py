"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set and the driver is the only machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="ledgerline-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/ledgerline/{label}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


#: Writer options for rows of many megabytes: readers take a row group at a time, so each holds few rows.
LARGE_ROWS = {"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def stash(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many staging tables there are: a mark for ``purge``."""
    return len(_STAGED)


def purge(spark: SparkSession | None = None, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the staging tables made after a mark, but those with a label of ``keep``; frames that still read the others must be written before."""
    for owner, path in _STAGED[since:]:
        if spark is not None and owner is not spark or any(path.rsplit("/", 1)[1].startswith(k) for k in keep):
            continue
        _STAGED.remove((owner, path))
        try:
            jvm, conf = owner._jvm, owner._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session may be gone at exit
            return


atexit.register(purge)
