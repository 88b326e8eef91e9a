"""Job events, sessions, usage and cost, errors, versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, nonempty, strip, text
from .ordering import dense_number

# Payload fields that never travel, and the status an event sets.
HEAVY_FIELDS = ["document_blocks", "pairs", "translation_pairs"]
EVENT_STATUS = {"translation_started": "translating", "completed": "done", "job_error": "error"}
MESSAGE_FIELDS = ["msg", "errMsg", "translation_error", "preview_error", "error", "message", "detail"]
DEFAULT_MESSAGE = "문서 번역 중 오류가 발생했습니다."
DEFAULT_CODE = "08099000"
CODE_FAMILIES = {"08000": "input", "08001": "model_call", "08002": "storage", "08003": "pipeline", "08099": "unknown"}


def drop_heavy(df: DataFrame, data: str | None = None) -> DataFrame:
    """Remove heavy columns, or heavy keys of a map column."""
    if data is None:
        return df.drop(*HEAVY_FIELDS)
    return df.withColumn(data, F.map_filter(data, lambda k, v: ~k.isin(HEAVY_FIELDS)))


def compact(df: DataFrame, columns: list[str]) -> DataFrame:
    """Empty text becomes null; empty values leave a map."""
    out = df
    for c in columns:
        if dict(df.dtypes)[c].startswith("map"):
            out = out.withColumn(c, F.map_filter(c, lambda k, v: v.isNotNull() & (v != "")))
        else:
            out = out.withColumn(c, F.nullif(F.col(c), F.lit("")))
    return out


def normalize_errors(df: DataFrame, data: str = "data") -> DataFrame:
    """First non-empty message field, code with default, and the code's family."""
    d = F.col(data)
    message = F.coalesce(*[F.nullif(text(d[f]), F.lit("")) for f in MESSAGE_FIELDS], F.lit(DEFAULT_MESSAGE))
    code = F.coalesce(F.nullif(text(d["error_code"]), F.lit("")), F.lit(DEFAULT_CODE))
    family = None
    for prefix, name in CODE_FAMILIES.items():
        hit = F.startswith(F.col("error_code"), F.lit(prefix))
        family = F.when(hit, name) if family is None else family.when(hit, name)
    detail = F.nullif(text(d["detail"]), F.lit(""))
    return df.withColumn("msg", message).withColumn("error_code", code).withColumn(
        "error_family", family.otherwise("unknown")
    ).withColumn("detail", F.when(detail != F.col("msg"), detail))


def number_events(events: DataFrame) -> DataFrame:
    """Dense event ids from 1 per job by time and sequence, in blocks of one hour."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("bigint")
    return dense_number(events, ["job_id"], ["ts", "seq"], "event_id", 1, block=hour)


def replay_events(events: DataFrame, last_event_id: int) -> DataFrame:
    """Events after a replay position, in order per job."""
    return events.where(F.col("event_id") > last_event_id)


def job_state(events: DataFrame) -> DataFrame:
    """Status of every job from its last status event, and its last payload values."""
    status = None
    for event, value in EVENT_STATUS.items():
        status = F.when(F.col("event") == event, value) if status is None else status.when(F.col("event") == event, value)
    at = F.struct("ts", "event_id")
    per_job = events.groupBy("job_id").agg(
        F.max_by(status, F.when(status.isNotNull(), at)).alias("status"), F.count(F.lit(1)).alias("event_count"),
        F.max_by("event", at).alias("last_event"), F.max("ts").alias("updated_at"),
    )
    return per_job.withColumn("status", F.coalesce("status", F.lit("pending")))


def job_payload(events: DataFrame) -> DataFrame:
    """Last value per job and payload key, heavy keys left out."""
    rows = drop_heavy(events, "data").select("job_id", "ts", "event_id", F.explode("data").alias("key", "value"))
    return rows.groupBy("job_id", "key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def job_outcomes(events: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Outcome and duration of finished jobs, with their token totals."""
    final = F.col("event").isin("completed", "job_error")
    out = events.groupBy("job_id").agg(
        F.min("ts").alias("created_at"),
        F.min(F.when(final, F.struct("ts", "event_id", "event"))).alias("_end"),
    ).where("_end is not null")
    elapsed = F.unix_micros(F.col("_end.ts").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    out = out.select(
        "job_id", F.when(F.col("_end.event") == "completed", "done").otherwise("error").alias("outcome"),
        F.greatest(F.lit(0).cast("bigint"), F.floor(elapsed / 1000).cast("bigint")).alias("elapsed_ms"),
    )
    if usage is None:
        return out
    totals = usage_rows(usage).groupBy("job_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )
    return out.join(totals, "job_id", "left").fillna(0, ["prompt_tokens", "completion_tokens"])


def progress(completed, total, elapsed_ms) -> Column:
    """Percent done and remaining milliseconds."""
    t = F.greatest(F.lit(0), F.coalesce(col(total), F.lit(0)))
    c = F.greatest(F.lit(0), F.coalesce(col(completed), F.lit(0)))
    c = F.when(t > 0, F.least(c, t)).otherwise(c)
    ms = F.greatest(F.lit(0), col(elapsed_ms)).cast("bigint")
    percent = F.bround(F.when(t > 0, c / t * 100.0).otherwise(0.0), 1)
    eta = F.when((c > 0) & (t > c), F.floor(ms / c * (t - c)).cast("bigint"))
    return F.struct(
        c.alias("progress_completed"), F.nullif(t, F.lit(0)).alias("progress_total"),
        percent.alias("progress_percent"), eta.alias("eta_ms"), ms.alias("progress_elapsed_ms"),
    )


def live_progress(events: DataFrame) -> DataFrame:
    """Completed units, percent and remaining time per job. Runs on tables and streams."""
    per = events.groupBy("job_id").agg(
        F.sum(F.when(F.col("event") == "blocks_translated", F.col("units")).otherwise(0)).alias("_done"),
        F.max("total_units").alias("_total"), F.min("ts").alias("_from"), F.max("ts").alias("_to"),
    )
    ms = F.floor((F.unix_micros(F.col("_to").cast("timestamp")) - F.unix_micros(F.col("_from").cast("timestamp"))) / 1000)
    return per.select("job_id", progress("_done", "_total", ms).alias("_p")).select("job_id", "_p.*")


# --- usage ------------------------------------------------------------------


def usage_rows(usage: DataFrame) -> DataFrame:
    """Negative counts become zero; rows without a model or any token drop out."""
    clean = usage.withColumn("prompt_tokens", F.greatest(F.coalesce("prompt_tokens", F.lit(0)), F.lit(0)).cast("bigint"))
    clean = clean.withColumn(
        "completion_tokens", F.greatest(F.coalesce("completion_tokens", F.lit(0)), F.lit(0)).cast("bigint")
    )
    return clean.where((text("model") != "") & ((F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0)))


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of every usage row; unknown models are marked, not charged."""
    rows = usage_rows(usage).join(prices, "model", "left")
    usd = (
        F.col("prompt_tokens") / 1_000_000 * F.col("input_usd_per_1m")
        + F.col("completion_tokens") / 1_000_000 * F.col("output_usd_per_1m")
    )
    return rows.withColumn("known_model", F.col("input_usd_per_1m").isNotNull()).withColumn(
        "cost_usd", F.coalesce(usd, F.lit(0.0))
    ).drop("input_usd_per_1m", "output_usd_per_1m", "usd_per_image")


def usage_by_model(usage: DataFrame) -> DataFrame:
    """Token totals per job and model. Runs on tables and streams."""
    return usage_rows(usage).groupBy("job_id", "model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        (F.sum("prompt_tokens") + F.sum("completion_tokens")).alias("total_tokens"), F.count(F.lit(1)).alias("turns"),
    )


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals per job and model with their price; the price table is a static side."""
    totals = usage_by_model(usage).join(prices, "model", "left")
    usd = (
        F.col("prompt_tokens") / 1_000_000 * F.col("input_usd_per_1m")
        + F.col("completion_tokens") / 1_000_000 * F.col("output_usd_per_1m")
    )
    return totals.select(
        "job_id", "model", "prompt_tokens", "completion_tokens", "total_tokens", "turns",
        F.col("input_usd_per_1m").isNotNull().alias("known_model"), F.bround(F.coalesce(usd, F.lit(0.0)), 6).alias("cost_usd"),
    )


def usage_totals(
    usage: DataFrame, prices: DataFrame, rate: float, images: DataFrame | None = None
) -> DataFrame:
    """Tokens and credit per job in local currency, six places, never negative."""
    tokens = usage_by_model(usage).join(prices, "model", "left")
    usd = (
        F.col("prompt_tokens") / 1_000_000 * F.col("input_usd_per_1m")
        + F.col("completion_tokens") / 1_000_000 * F.col("output_usd_per_1m")
    )
    per_job = tokens.groupBy("job_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"), F.sum(F.coalesce(usd, F.lit(0.0))).alias("_usd"),
        F.count_if(F.col("input_usd_per_1m").isNull()).alias("unpriced_models"),
    )
    if images is not None:
        counted = images.where((text("model") != "") & (F.col("image_count") > 0)).join(prices, "model", "left")
        extra = counted.groupBy("job_id").agg(F.sum(F.coalesce(F.col("image_count") * F.col("usd_per_image"), F.lit(0.0))).alias("_img"))
        per_job = per_job.join(extra, "job_id", "left").withColumn("_usd", F.col("_usd") + F.coalesce("_img", F.lit(0.0))).drop("_img")
    credit = F.bround(F.greatest(F.col("_usd") * rate, F.lit(0.0)), 6)
    return per_job.withColumn("credit", credit).drop("_usd")


# --- stored state -----------------------------------------------------------


def next_version(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Next version number per job; one without stored versions starts at 1."""
    last = stored.groupBy("job_id").agg((F.max("version") + 1).alias("_next"))
    return requested.select("job_id").distinct().join(last, "job_id", "left").select(
        "job_id", F.coalesce("_next", F.lit(1)).cast("bigint").alias("next_version")
    )


def reuse_or_compute(
    requested: DataFrame, stored: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "job_id"
) -> DataFrame:
    """Stored rows of the requested jobs, and freshly built rows for the missing ones."""
    jobs = requested.select(key).distinct()
    reused = stored.join(jobs, key, "left_semi").withColumn("reused", F.lit(True))
    missing = jobs.join(stored.select(key).distinct(), key, "left_anti")
    return reused.unionByName(build(missing).withColumn("reused", F.lit(False)))


def latest_session_state(changes: DataFrame, now: Column) -> DataFrame:
    """Last value per session and key that has not expired."""
    last = changes.groupBy("session_id", "key").agg(
        F.max_by(F.struct("value", "updated_at", "ttl_seconds"), F.struct("updated_at", "change_id")).alias("_l")
    ).select("session_id", "key", "_l.*")
    age = (F.unix_micros(now) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 1_000_000
    return last.where(F.col("ttl_seconds").isNull() | (age <= F.col("ttl_seconds")))
