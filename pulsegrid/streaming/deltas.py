"""The delta of ``pulsegrid.operators.series`` on streams: each series keeps its last sample as state."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.operators.series import series_of

OUT = "sample_id long, start_ust long, end_ust long, elapsed_cs long, delta decimal(20,0), wrapped boolean, reason string"
STATE = "sample_id long, ust long, uptime_cs decimal(20,0), segment long, raw decimal(20,0)"


def streaming_deltas(samples: DataFrame) -> DataFrame:
    """From a stream of (host, activity, item, field, segment, sample_id, ust, uptime_cs, raw, bits), in order within each series.

    Of the first four those that the stream has name a series. A sample that is not newer than the last of
    its series is left out. State is one sample for each series; a series that begins late counts as new,
    as the stream doesn't remember the other series of its activity.
    """
    keys = series_of(samples)
    columns = [*keys, *(c.split()[0] for c in OUT.split(", "))]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("sample_id", kind="stable").drop_duplicates("sample_id")
        if last is not None:
            rows = rows[rows["sample_id"] > last[0]]
        if not len(rows):
            return
        fields = ("sample_id", "ust", "uptime_cs", "segment", "raw")
        # exact whole numbers: 64-bit counters don't fit a signed array
        now = {c: np.array([int(x) for x in rows[c]], object) for c in fields}
        before = {c: np.append(np.array([now[c][0] if last is None else int(last[k])], object), now[c][:-1]) for k, c in enumerate(fields)}
        bits, first = rows["bits"].to_numpy(), np.zeros(len(rows), bool)
        first[0] = last is None
        apart = now["uptime_cs"] - before["uptime_cs"]
        near = (now["segment"] == before["segment"]) & (now["sample_id"] == before["sample_id"] + 1)
        elapsed = np.where(near & (apart > 0) & (apart < 1 << 62), apart, 0)
        back = now["raw"] < before["raw"]
        conditions = [first, now["segment"] != before["segment"], ~near, elapsed == 0, back & (bits == 64)]
        reason = np.select([c.astype(bool) for c in conditions], ["first_sample", "restart", "item_replaced", "non_positive_elapsed", "ambiguous_decrease"], "")
        fine = reason == ""
        delta = [Decimal((a - b) % (1 << int(w))) if ok else None for a, b, w, ok in zip(now["raw"], before["raw"], bits, fine)]
        out = dict(zip(keys, key)) | {
            "sample_id": now["sample_id"].astype(np.int64),
            "start_ust": before["ust"].astype(np.int64),
            "end_ust": now["ust"].astype(np.int64),
            "elapsed_cs": elapsed.astype(np.int64),
            "delta": delta,
            "wrapped": (fine & back).astype(bool),
            "reason": [r or None for r in reason],
        }
        end = {c: x[-1] for c, x in now.items()}
        state.update((end["sample_id"], end["ust"], Decimal(end["uptime_cs"]), end["segment"], Decimal(end["raw"])))
        yield pd.DataFrame(out)[columns]

    kinds = dict(samples.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keys] + [OUT])
    return samples.groupBy(*keys).applyInPandasWithState(fold, schema, STATE, "append", GroupStateTimeout.NoTimeout)
