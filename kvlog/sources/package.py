"""Gives the package to the Python workers."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def give(spark: SparkSession) -> None:
    """Adds the package to the session's files, once per context; executors fetch it from the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_kvlog_given", False):
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    at = pathlib.Path(tempfile.mkdtemp(prefix="kvlog-package-")) / "kvlog-package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._kvlog_given = True


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: that of ``spark.checkpoint.dir``; a temporary one on a local master alone."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at:
        return f"{at}/kvlog"
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(sc, "_kvlog_scratch", None):
        sc._kvlog_scratch = "file://" + tempfile.mkdtemp(prefix="kvlog-scratch-")
    return sc._kvlog_scratch
