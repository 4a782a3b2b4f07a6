"""Ways to take quantiles of many tensors, timed against each other."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import stats

# The columns that readers of the report expect.
COLUMNS = ("strategy_name", "tensor_count", "total_input_bytes", "total_time_ms", "effective_bandwidth_gbps")
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "running_counts": lambda t: stats.quantiles(t, {"q1": 0.25, "median": 0.5, "q3": 0.75}),
    "sorted_buffer": lambda t: t.groupBy("tensor_id").agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q")),
    "sketch": lambda t: t.groupBy("tensor_id").agg(F.percentile_approx("value", [0.25, 0.5, 0.75]).alias("q")),
}


def quantile_strategies(t: DataFrame) -> DataFrame:
    """A row per strategy over the same elements (tensor_id, value): time and bytes a second, 0 of nothing."""
    n, elements = t.agg(F.countDistinct("tensor_id"), F.count("value")).first()
    rows = []
    for name, run in STRATEGIES.items():
        began = time.perf_counter()
        run(t).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        rows.append((name, n, 4 * elements, took * 1e3, 4 * elements / took / 1e9 if elements else 0.0))
    return t.sparkSession.createDataFrame(rows, "strategy_name string, tensor_count long, total_input_bytes long, total_time_ms double, effective_bandwidth_gbps double")
