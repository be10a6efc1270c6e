"""Session set-up for local runs; a cluster's own session is used as it comes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, name: str = "tidemark") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_importable(spark: SparkSession) -> None:
    """Ships the package to Python workers that would not find it by themselves."""
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    places = [Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(":")))]
    context = spark.sparkContext
    if root in [p.resolve() for p in places] or getattr(context, "_tidemark_shipped", False):
        return
    to = Path(tempfile.mkdtemp()) / "tidemark.zip"
    with zipfile.ZipFile(to, "w") as made:
        for file in sorted((root / "tidemark").rglob("*.py")):
            made.write(file, file.relative_to(root))
    context.addPyFile(str(to))
    context._tidemark_shipped = True
