"""Brings the package's own code to the Python workers, wherever they and the driver were started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors once for each application; Spark itself distributes the archive."""
    application = spark.sparkContext.applicationId
    if application not in _SENT:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="quarryspark-")) / "quarryspark_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(str(archive))
        _SENT.add(application)
    return spark
