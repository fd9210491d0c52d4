"""Partitions of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files over as many partitions as there are cores, if it has fewer; else the scan as it is, without a shuffle.

    One file of one row group is one task, however many cores wait. What is moved is less than a partition for each core. For plain scans only:
    counting the partitions of a plan with shuffles would run them.
    """
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
