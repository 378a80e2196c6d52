"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes of a batch that goes to a Python worker, about: long texts come a few at a time.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application; bound their batches unless the application does."""
    if not spark.sparkContext.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="ledgerline-")) / "ledgerline.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(bundle))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
