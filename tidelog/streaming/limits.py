"""The token bucket as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators.limits import check_bucket, token_step


def token_bucket(requests: DataFrame, capacity: int, rate: float) -> DataFrame:
    """Decisions for a stream of requests (key, ms, seq), which must come in order per key between batches."""
    check_bucket(capacity, rate)
    step = token_step(capacity, rate)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ms", "seq"], kind="stable")
        out = []
        for ms, seq in zip(rows["ms"].tolist(), rows["seq"].tolist(), strict=True):
            now, (allowed, remaining) = step(now, ms)
            out.append((key[0], seq, allowed, remaining))
        state.update((float(now[0]), int(now[1])))
        yield pd.DataFrame(out, columns=["key", "seq", "allowed", "remaining"])

    return requests.groupBy("key").applyInPandasWithState(run, "key string, seq long, allowed boolean, remaining long", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)
