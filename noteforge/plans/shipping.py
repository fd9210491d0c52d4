"""Brings the package to executors that don't have it."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import noteforge

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(noteforge.__file__).resolve().parent.parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='noteforge-')}/noteforge", "zip", root, "noteforge")
        context.addPyFile(made)
        _SHIPPED.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package at hand on executors."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    run.__name__ = query.__name__
    return run
