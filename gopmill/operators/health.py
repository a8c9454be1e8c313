"""Heartbeats: who is known, and who has gone silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gopmill.operators import slices
from gopmill.operators.rangejoin import spread_hot

DEAD_AFTER_SECS = 10


def known_heartbeats(heartbeats: DataFrame, nodes: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Heartbeats of registered nodes."""
    dealt, repeated, on = spread_hot(heartbeats, nodes.select("node_id"), ["node_id"], rows_per_task)
    return dealt.join(repeated, on, "left_semi").select(*heartbeats.columns)


def unknown_heartbeats(heartbeats: DataFrame, nodes: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Heartbeats of nodes nobody registered."""
    dealt, repeated, on = spread_hot(heartbeats, nodes.select("node_id"), ["node_id"], rows_per_task)
    return dealt.join(repeated, on, "left_anti").select(*heartbeats.columns)


def silent_intervals(
    heartbeats: DataFrame,
    as_of: Column,
    timeout_secs: int = DEAD_AFTER_SECS,
    self_id: object | None = None,
    slice_days: int = 1,
    registrations: DataFrame | None = None,
) -> DataFrame:
    """(node_id, last_beat, dead_from, back_at) of every gap longer than the timeout.

    The gap after the last beat is judged at ``as_of`` and has no ``back_at``. The node ``self_id`` never
    declares itself dead. Beats of one instant are no gap apart. With ``registrations(node_id, registered_at)`` a node's
    clock starts there: the first gap begins with its registration, which then stands as ``last_beat``, whether or not a
    beat ever follows.
    """
    signs = heartbeats.select("node_id", "ts")
    if registrations is not None:
        since = F.col("registered_at").cast(heartbeats.schema["ts"].dataType).alias("ts")
        signs = signs.unionByName(registrations.select("node_id", since).where(F.col("ts").isNotNull() & (F.col("ts") <= as_of)))
    beats = signs if self_id is None else signs.where(F.col("node_id") != F.lit(self_id))
    span = F.floor(F.unix_date(F.to_date("ts")) / F.lit(slice_days)).cast("bigint")
    carried = slices.inherit(
        beats, ["node_id"], span, [F.min("ts").alias("_first")], lambda w: [F.lead("_first").over(w).alias("_beyond")]
    )
    next_beat = F.coalesce(F.lead("ts").over(slices.in_slice(["node_id"], ["ts"])), F.col("_beyond"))
    paired = carried.withColumn("back_at", next_beat)
    limit = F.make_dt_interval(secs=F.lit(timeout_secs))
    until = F.coalesce(F.col("back_at"), as_of)
    return paired.where(until - F.col("ts") > limit).select(
        "node_id", F.col("ts").alias("last_beat"), (F.col("ts") + limit).alias("dead_from"), "back_at"
    )


def latest_status(heartbeats: DataFrame, nodes: DataFrame, as_of: Column, timeout_secs: int = DEAD_AFTER_SECS) -> DataFrame:
    """(node_id, status, last_beat) at ``as_of``, from the status at registration and the beats since.

    A beat at capacity makes a node Busy; one below it makes a Busy or Dead node Active and leaves Joining
    and Draining alone. A node that was ever full, or ever silent, before its last beat below capacity is
    Active there, so only three facts per node are needed: was it ever Busy or Dead, is the last beat
    full, and is it recent. With ``registered_at`` in ``nodes`` the clock of a node starts with its registration, so one that
    never beats is Dead past the timeout; a beat from before it is an unknown node's. Without it such a node stays as it is.
    """
    known = known_heartbeats(heartbeats.where(F.col("ts") <= as_of), nodes)
    registered = nodes.select("node_id", "registered_at") if "registered_at" in nodes.columns else None
    since = F.lit(None).cast(heartbeats.schema["ts"].dataType)
    if registered is not None:
        since = F.col("registered_at").cast(heartbeats.schema["ts"].dataType)
        known = known.join(registered, "node_id").where(F.coalesce(F.col("ts") >= since, F.lit(True))).select(*known.columns)
    full = F.col("active_workers") >= F.col("max_concurrent_workers")
    facts = known.groupBy("node_id").agg(
        F.max("ts").alias("last_beat"),
        F.max_by(full, "ts").alias("_full"),
        F.bool_or(full).alias("_ever_full"),
    )
    gaps = silent_intervals(known, as_of, timeout_secs, registrations=registered).where(F.col("back_at").isNotNull())
    ever_dead = gaps.select("node_id").distinct().withColumn("_ever_dead", F.lit(True))
    joined = nodes.select("node_id", "status", since.alias("_since")).join(facts, "node_id", "left").join(ever_dead, "node_id", "left")
    freed = F.col("_ever_full") | F.coalesce("_ever_dead", F.lit(False)) | F.col("status").isin("Busy", "Dead")
    silent = as_of - F.coalesce("last_beat", "_since") > F.make_dt_interval(secs=F.lit(timeout_secs))
    status = (
        F.when(F.col("last_beat").isNull(), F.when(silent, "Dead").otherwise(F.col("status")))
        .when(silent, "Dead")
        .when(F.col("_full"), "Busy")
        .when(freed, "Active")
        .otherwise(F.col("status"))
    )
    return joined.select("node_id", status.alias("status"), "last_beat")
