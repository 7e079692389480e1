"""What Python workers and executors share with the driver: the package, and a folder."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> SparkSession:
    """Put the repository on the path of Python workers that start later, wherever the driver was started.

    For machines that see the repository under the same path; elsewhere ship a zip with ``addPyFile``.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode, where it is unset, a temporary one.

    On a cluster a folder of one machine would do harm without a word: the others would not see its files. So there the setting must be made.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = getattr(spark.sparkContext, "_tallyweave_dir", None)
        if place is None:
            place = spark.sparkContext._tallyweave_dir = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    return place.rstrip("/")
