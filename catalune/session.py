"""A Spark session with what the engine relies on: UTC, adaptive execution, no guessing of partition numbers."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "catalune", **conf: str) -> SparkSession:
    """The current session, or a new one. On a cluster the master and resources come from spark-submit."""
    b = SparkSession.builder.appName(app)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (own | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application: they may have no copy of their own."""
    import shutil
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        copy = Path(tempfile.mkdtemp(prefix="catalune-"))
        shutil.copytree(root, copy / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(copy / "catalune"), "zip", copy / "src"))
        shutil.rmtree(copy / "src")
        _SHIPPED.add(sc.applicationId)
