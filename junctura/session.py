"""Session settings the operators rely on, and shipping this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session as the tests and the bench use it: UTC, adaptive plans, a bounded number of partitions."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="junctura-")) / "junctura.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, Path(root.name) / source.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark


def shipping(query):
    """A query that first makes sure that executors can import what it runs there."""

    @wraps(query)
    def run(spark, *args):
        return query(ship(spark), *args)

    return run
