"""Session helper for local runs, and table access."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrybed")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package where neither their folder nor PYTHONPATH has it."""
    root = Path(__file__).resolve().parent.parent
    seen = [Path.cwd(), *(Path(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)]
    if any((p / "quarrybed").is_dir() for p in seen) or spark.conf.get("quarrybed.shipped", ""):
        return
    out = Path(tempfile.mkdtemp(prefix="quarrybed-ship-")) / "quarrybed.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((root / "quarrybed").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    spark.conf.set("quarrybed.shipped", "true")
