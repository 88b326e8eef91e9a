"""Job events and usage as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed as K
from ..operators.jobs import EVENT_STATUS, drop_heavy, live_progress, usage_by_model


def job_state_stream(events: DataFrame) -> DataFrame:
    """Status per job, updated with every micro-batch.

    Events may arrive in any order: the state keeps the position of the newest
    event and of the newest status event, not the events.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_at, last, status_at, status, count = state.get if state.exists else (-1, "", -1, "pending", 0)
        for batch in batches:
            count += len(batch)
            newest = batch.loc[batch.event_id.idxmax()]
            if newest.event_id > last_at:
                last_at, last = int(newest.event_id), newest.event
            known = batch[batch.event.isin(EVENT_STATUS)]
            if len(known) and known.event_id.max() > status_at:
                row = known.loc[known.event_id.idxmax()]
                status_at, status = int(row.event_id), EVENT_STATUS[row.event]
        state.update((last_at, last, status_at, status, count))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "event_count": [count], "last_event": [last]})

    job_type = events.schema["job_id"].dataType.simpleString()
    return events.select("job_id", "event_id", "event").groupBy("job_id").applyInPandasWithState(
        update,
        f"job_id {job_type}, status string, event_count bigint, last_event string",
        "last_at bigint, last string, status_at bigint, status string, count bigint",
        "update", GroupStateTimeout.NoTimeout,
    )


class _Payload(StatefulProcessor):
    """Last value of every payload key with the position of the event that wrote it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "name string", "value string, at bigint, event_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple] = {}
        for batch in rows:
            for name, value, at, event_id in zip(*(batch[c] for c in ("name", "value", "at", "event_id"))):
                if name not in newest or newest[name][1:] < (int(at), int(event_id)):
                    newest[name] = (value, int(at), int(event_id))
        changed = []
        for name, new in newest.items():
            old = self.values.getValue((name,)) if self.values.containsKey((name,)) else None
            if old and tuple(old)[1:] >= new[1:]:
                continue
            self.values.updateValue((name,), new)
            changed.append((key[0], name, new[0]))
        if changed:
            yield pd.DataFrame(changed, columns=["job_id", "key", "value"])

    def close(self) -> None:
        pass


def job_payload_stream(events: DataFrame) -> DataFrame:
    """Payload keys whose value has changed: the last writer by (ts, event_id) wins, in whatever order events arrive.

    ``data`` is a map; heavy keys are left out before they reach the state.
    """
    job_type = events.schema["job_id"].dataType.simpleString()
    rows = drop_heavy(events, "data").select(
        "job_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.explode("data").alias("name", "value")
    )
    return rows.groupBy("job_id").transformWithStateInPandas(_Payload(), f"job_id {job_type}, key string, value string", "Update", "None")


def live_progress_stream(events: DataFrame) -> DataFrame:
    """Percent and remaining time per job; write in update mode."""
    return live_progress(events)


def usage_stream(usage: DataFrame) -> DataFrame:
    """Running token totals per job and model; write in update mode."""
    return usage_by_model(usage)


def priced(totals: DataFrame, prices: DataFrame) -> DataFrame:
    """Join a static price table to running totals."""
    rows = totals.join(prices, "model", "left")
    usd = F.col("prompt_tokens") / 1_000_000 * F.col("input_usd_per_1m") + F.col("completion_tokens") / 1_000_000 * F.col("output_usd_per_1m")
    return rows.select(
        "job_id", "model", "prompt_tokens", "completion_tokens", "total_tokens", "turns",
        F.col("input_usd_per_1m").isNotNull().alias("known_model"), F.bround(F.coalesce(usd, F.lit(0.0)), 6).alias("cost_usd"),
    )


def dedupe_observation_stream(observed: DataFrame, time: str = "observed_at") -> DataFrame:
    """Drop repeated observation keys; the watermark is the lifetime of the memory."""
    return observed.withWatermark(time, f"{K.MEMORY_TTL_SECONDS} seconds").dropDuplicatesWithinWatermark(
        ["doc_id", "term_id", "observation_key"]
    )
