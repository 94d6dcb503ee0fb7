"""Session defaults."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from colophon.storage import shared_dir

#: Settings that every query here expects; a cluster's own values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | None = None, shuffle_partitions: int | None = None, name: str = "colophon") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", os.environ.get("COLOPHON_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, as a zip of its sources in the shared folder."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        target = f"{shared_dir(spark)}/colophon/sources-{context.applicationId}/colophon.zip"
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(held.getvalue()))
        out.close()
        context.addPyFile(target)
        _SHIPPED.add(context.applicationId)
    return spark
