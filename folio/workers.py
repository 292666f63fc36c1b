"""Python workers on executors need this package; where they have no path to it, the session ships it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package along with the session's tasks, once, unless ``PYTHONPATH`` already leads to it."""
    sc = spark.sparkContext
    if getattr(sc, "_folio_shipped", False) or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="folio-")) / "folio.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "folio").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._folio_shipped = True
