"""Gets this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors of a session once, as a zip file, so that Python workers can import it."""
    context = spark.sparkContext
    if not getattr(context, "_concordia_shipped", False):
        home = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="concordia-")) / "concordia.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, p.relative_to(home.parent))
        context.addPyFile(str(target))
        context._concordia_shipped = True
    return spark
