"""Recursive indicators with several outputs as SQL table functions over a partitioned, ordered TABLE argument."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.indicators import REGISTRY

#: Types with a kernel and several outputs.
NAMES = tuple(k for k, spec in REGISTRY.items() if spec.kernel and len(spec.outputs) > 1)
_INPUTS = ("open", "high", "low", "close", "volume")


def _function(key: str):
    spec = REGISTRY[key]

    class Walk:
        def __init__(self):
            self.rows = []

        def eval(self, row):
            self.rows.append((row["ticker"], row["date"], *(row[x] for x in _INPUTS)))

        def terminate(self):
            if not self.rows:
                return
            bars = {x: np.array([r[k + 2] for r in self.rows], dtype=np.float64) for k, x in enumerate(_INPUTS)}
            outputs = spec.kernel(bars, spec.defaults)
            for k, (ticker, date, *_) in enumerate(self.rows):
                yield (ticker, date, *(None if np.isnan(x[k]) else float(x[k]) for x in outputs))

    return udtf(Walk, returnType="ticker string, date date, " + ", ".join(f"{x} double" for x in spec.outputs))


def register_functions(spark: SparkSession) -> None:
    """Makes each of NAMES a table function: SELECT * FROM macd(TABLE(bars) PARTITION BY ticker ORDER BY date), with default parameters."""
    for key in NAMES:
        spark.udtf.register(key, _function(key))
