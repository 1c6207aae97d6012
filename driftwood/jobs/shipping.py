"""Makes this package importable in Spark's Python workers, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    path = Path(tempfile.mkdtemp(prefix="driftwood-")) / "driftwood.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent).as_posix())
    sc.addPyFile(str(path))
    _SENT.add(sc.applicationId)
