"""Shipping of this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

MOST_BYTES = 4 << 20  # of a batch for a Python kernel
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: they need not share the driver's folders.

    Batches of the session's Python kernels hold MOST_BYTES at most (one row at least): by rows alone, a whole partition of
    texts is one batch, which the executor's JVM holds outside its heap and the worker once more.
    """
    sc = spark.sparkContext
    if sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)) > MOST_BYTES:
        spark.conf.set(BATCH, str(MOST_BYTES))
    if getattr(sc, "_quire_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():
        path = Path(tempfile.mkdtemp()) / "quire_code.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
    sc._quire_shipped = True
