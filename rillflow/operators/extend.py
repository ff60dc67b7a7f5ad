"""What a user adds: contracts of own operators, and how each is run over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.ship import ship
from rillflow.operators.recurrent import Kernel


class StatefulOp(Protocol):
    """One sample out for each in; any split of the input gives the same output."""

    def init_state(self) -> Any: ...
    def step(self, state: Any, x: np.ndarray) -> tuple[Any, np.ndarray]: ...


class RateOp(Protocol):
    """Any number of samples out; finish() gives what is left at the end."""

    def init_state(self) -> Any: ...
    def pull(self, state: Any, x: np.ndarray) -> tuple[Any, np.ndarray]: ...
    def finish(self, state: Any) -> np.ndarray: ...


class EventConsumer(Protocol):
    """Renders a stretch of samples, and takes an event between two stretches."""

    def init_state(self) -> Any: ...
    def apply(self, state: Any, event: Any) -> Any: ...
    def render(self, state: Any, x: np.ndarray) -> tuple[Any, np.ndarray]: ...


def checked(op: Any, contract: type) -> Any:
    names = [k for k in vars(contract) if not k.startswith("_")]
    if missing := [k for k in names if not callable(getattr(op, k, None))]:
        raise TypeError(f"{type(op).__name__} is no {contract.__name__}: it has no {', '.join(missing)}")
    return op


def kernel(op: StatefulOp) -> Kernel:
    """For run, run_chunked and run_stream."""
    checked(op, StatefulOp)
    return lambda state, x: op.step(op.init_state() if state is None else state, x)


def run_rate(df: DataFrame, op: RateOp) -> DataFrame:
    """(signal_id, n, y), n from 0 in each signal."""
    checked(op, RateOp)
    ship(df.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        state, y = op.pull(op.init_state(), pdf.sort_values("n")["x"].to_numpy())
        y = np.concatenate([y, op.finish(state)])
        return pd.DataFrame({"signal_id": pdf["signal_id"].iloc[0], "n": np.arange(len(y)), "y": y})

    return df.select("signal_id", "n", "x").groupBy("signal_id").applyInPandas(one, "signal_id string, n long, y double")


def run_events(df: DataFrame, events: DataFrame, op: EventConsumer) -> DataFrame:
    """Events (signal_id, at, seq, value) apply before the sample at which they are; those past the end are not heard."""
    checked(op, EventConsumer)
    ship(df.sparkSession)

    def one(signal: pd.DataFrame, lane: pd.DataFrame) -> pd.DataFrame:
        signal = signal.sort_values("n")
        n, x = signal["n"].to_numpy(), signal["x"].to_numpy()
        state, out, at = op.init_state(), [], 0
        for e in lane.sort_values(["at", "seq"]).itertuples():
            to = max(at, int(np.searchsorted(n, e.at)))
            state, y = op.render(state, x[at:to])
            out.append(y)
            state, at = op.apply(state, e), to
        state, y = op.render(state, x[at:])
        return pd.DataFrame({"signal_id": signal["signal_id"].to_numpy(), "n": n, "y": np.concatenate([*out, y])})

    by = df.select("signal_id", "n", "x").groupBy("signal_id")
    return by.cogroup(events.groupBy("signal_id")).applyInPandas(one, "signal_id string, n long, y double")


def channel_map(df: DataFrame, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A mono operator over every channel of (signal_id, n, ch, x): the channel joins the key, so channels are tasks of their own."""
    key = F.concat(F.col("ch").cast("string"), F.lit(":"), F.col("signal_id"))
    out = op(df.select(key.alias("signal_id"), "n", "x"))
    at = F.instr("signal_id", ":")
    return out.withColumn("ch", F.substring("signal_id", F.lit(1), at - 1).cast("int")).withColumn("signal_id", F.substring("signal_id", at + 1, F.length("signal_id")))
