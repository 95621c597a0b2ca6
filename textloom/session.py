"""Session helpers: defaults for stand-alone use and shipping the package to executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is designed for (AQE on, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors once per application, so that functions which run there can import it. Without a session the active one is meant."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    at = os.path.join(tempfile.mkdtemp(prefix="textloom-"), f"{root.name}.zip")
    Path(at).write_bytes(buf.getvalue())
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)
