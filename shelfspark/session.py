"""Session defaults and shipping of this package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings the engine relies on or profits from; a session that exists already keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "200",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def get_session(app: str = "shelfspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map={**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}})
    return (builder.master(master) if master else builder).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_shelfspark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="shelfspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it lives
    shutil.copytree(here, f"{folder}/src/shelfspark", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/shelfspark", "zip", f"{folder}/src"))
    context._shelfspark_shipped = True
