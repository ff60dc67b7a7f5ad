"""The batch kernels on Structured Streaming: state is kept per signal, rows of a micro-batch are applied in order of n.

A row that comes later than rows already applied is applied at the current position (it isn't dropped); n in the result tells which."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillflow.functions.ship import ship
from rillflow.operators.recurrent import Kernel


def run_stream(df: DataFrame, kernel: Kernel, col: str = "x") -> DataFrame:
    """A streaming (signal_id, n, x) to (signal_id, n, y) in append mode."""
    ship(df.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        parts = list(batches)
        pdf = (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values("n")
        held, y = kernel(held, pdf[col].to_numpy())
        state.update((pickle.dumps(held),))
        yield pd.DataFrame({"signal_id": key[0], "n": pdf["n"].to_numpy(), "y": y})

    return df.select("signal_id", "n", col).groupBy("signal_id").applyInPandasWithState(step, "signal_id string, n long, y double", "state binary", "append", GroupStateTimeout.NoTimeout)


def replay(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Run a streaming DataFrame over what is there now, into Parquet."""
    query = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
