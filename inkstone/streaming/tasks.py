"""Task state: the latest status per task from its event stream.

Batch form: one ``groupBy(task_id)`` with ``max_by`` over (event_at,
event_id) — a partial aggregate, so a hot task is combined map-side.
Streaming form: the same aggregate as a stateful streaming aggregation in
``update`` mode (state = one row per task), with a watermark bounding how
late a redelivered event may arrive; duplicates are dropped by event id
within the watermark first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS_SUBJECTS = ["pending", "processing", "done", "failed"]


def uuid_of(x: Column) -> Column:
    """Deterministic version-4-shaped UUID text from any key (md5 based)."""
    h = F.md5(x.cast("string"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"),
                    F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"),
                    F.substring(h, 21, 12))


def _order() -> Column:
    return F.struct(F.col("event_at"), F.col("event_id"))


def task_state(messages: DataFrame) -> DataFrame:
    """(id, task_id, status, error_message, created_at, updated_at, n_events).

    ``status`` follows the newest status event; a ``failed`` event stores
    its payload as the error message, which later status updates do not
    clear (the reference's two UPDATE statements).
    """
    ev = messages.filter(F.col("subject").isin(STATUS_SUBJECTS))
    agg = ev.groupBy("task_id").agg(
        F.max_by("subject", _order()).alias("status"),
        F.max_by(F.when(F.col("subject") == "failed", F.col("payload")),
                 F.when(F.col("subject") == "failed", _order())).alias("error_message"),
        F.min("event_at").alias("created_at"),
        F.max("event_at").alias("updated_at"),
        F.count("*").alias("n_events"),
    )
    return agg.select(F.col("task_id").alias("id"), uuid_of(F.col("task_id")).alias("task_id"),
                      "status", "error_message", "created_at", "updated_at", "n_events")
