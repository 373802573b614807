"""Gives executors this package, so that Arrow kernels can be imported where only the driver has it on its path."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from folioscope.operators.components import shared_dir

PACKAGE = Path(__file__).resolve().parent.parent
#: Bytes of an Arrow batch where the session leaves Spark's default of 64 MB: texts are wide rows, and both sides hold a batch.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def packed() -> bytes:
    """The package's sources as a zip."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE).as_posix()}")
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files once, through the folder that all executors share."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH, "67108864b").removesuffix("b") == str(64 << 20):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if getattr(sc, "_folioscope_shipped", False):
        return
    path = f"{shared_dir(spark)}/{sc.applicationId}/folioscope.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(packed()))
    finally:
        out.close()
    sc.addPyFile(path)
    sc._folioscope_shipped = True
