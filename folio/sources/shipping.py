"""Sends this package to the Python workers, which may not share the driver's import path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Adds the package as a zip file to the session's application, once."""
    context = (spark or SparkSession.active()).sparkContext
    if context.applicationId in _done:
        return
    root = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as build:
        shutil.copytree(root, Path(build, "src", root.name), ignore=shutil.ignore_patterns("__pycache__"))
        place = tempfile.mkdtemp(prefix="folio-")  # the driver serves the file from here to the executors
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        context.addPyFile(shutil.make_archive(str(Path(place, root.name)), "zip", Path(build, "src")))
    _done.add(context.applicationId)
