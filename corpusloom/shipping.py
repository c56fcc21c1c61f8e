"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application once; Spark hands the archive to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    own = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{own.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(own.rglob("*.py")):
            out.write(path, path.relative_to(own.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
