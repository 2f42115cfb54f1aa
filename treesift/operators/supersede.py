"""Cancelling searches that a newer one has replaced."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from threading import Lock
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


class Latest:
    """Runs jobs for one client, of which only the newest matters: starting one interrupts the one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._tag = spark, Lock(), None

    def run(self, job: Callable[[], T]) -> T:
        """The job's result.  A job that was replaced ends with an error in its own thread."""
        tag = f"treesift-{uuid.uuid4().hex}"
        with self._lock:
            before, self._tag = self._tag, tag
        if before:
            self.spark.interruptTag(before)
        self.spark.addTag(tag)
        try:
            return job()
        finally:
            self.spark.removeTag(tag)
            with self._lock:
                if self._tag == tag:
                    self._tag = None
