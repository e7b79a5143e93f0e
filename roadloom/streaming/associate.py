"""Association of arriving points with roads.

The nearest road of a point depends on that point and the roads only, so each micro-batch is joined with the static
roads. Clusters depend on all points: :func:`cluster_sink` recomputes them over everything that has arrived.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from roadloom.operators import associate, dbscan


def associate_stream(points: DataFrame, roads: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each micro-batch of ``points`` (``point_idx, x, y``) with its roads to ``out`` as ``batch=<n>``; rerunning a batch replaces it."""

    def one(batch: DataFrame, n: int) -> None:
        associate.associate(batch, roads).write.mode("overwrite").parquet(os.path.join(out, f"batch={n}"))

    return points.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def cluster_sink(adjacent: DataFrame, eps: float, min_pts: int, use: Callable[[DataFrame, int], None], seen: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: keep the associated points of each batch in ``seen`` and give all labels so far to ``use``."""

    def one(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(seen, f"batch={n}"))
        arrived = batch.sparkSession.read.schema(batch.schema).parquet(seen)
        use(dbscan.cluster(arrived, adjacent, eps, min_pts), n)

    return one
