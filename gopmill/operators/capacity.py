"""Node capacity and the filling of free slots with the hardest pending segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gopmill.operators import slices

CELLS = 1024


def active_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("status").isin("Active", "Busy"))


def schedulable_nodes(nodes: DataFrame, connections: DataFrame) -> DataFrame:
    """Active or busy nodes with a live connection (connections.node_id)."""
    return active_nodes(nodes).join(connections.select("node_id").distinct(), "node_id", "left_semi")


def free_slots() -> Column:
    return F.greatest(F.col("max_concurrent_workers") - F.col("active_workers"), F.lit(0))


def available_slots(nodes: DataFrame) -> DataFrame:
    """One row: free slots over active and busy nodes."""
    return active_nodes(nodes).agg(F.coalesce(F.sum(free_slots()), F.lit(0)).cast("bigint").alias("available_slots"))


def node_slot_ranges(nodes: DataFrame) -> DataFrame:
    """Active nodes with free slots, strongest first: the slot numbers ``first_slot``..``last_slot`` each owns.

    Strength is free slots times cores, ties by node id.
    """
    open_nodes = nodes.where(F.col("status") == "Active").withColumn("slots", free_slots()).where(F.col("slots") > 0)
    strength = (F.col("slots") * F.col("cpu_cores")).desc()
    ranged = slices.range_slices(open_nodes, [strength, F.col("node_id")])
    summed = slices.global_running_sum(ranged, F.col("slots"), "last_slot")
    return summed.select(
        "node_id", "cpu_cores", "slots",
        (F.col("last_slot") - F.col("slots") + 1).cast("bigint").alias("first_slot"),
        F.col("last_slot").cast("bigint").alias("last_slot"),
    )


def pending_order() -> list[Column]:
    return [F.col("job_id"), F.col("complexity_estimate").desc(), F.col("segment_id")]


def priority_rank(segments: DataFrame) -> DataFrame:
    """Segments with ``priority`` 1.. within their job: hardest first, ties in segment order.

    The range partitions of one global order are the slices of every job, so the largest job is spread over as
    many tasks as it needs.
    """
    ranged = slices.range_slices(segments, pending_order())
    ranked = slices.row_number(ranged, ["job_id"], F.col(slices.SLICE), ["_at"], "priority")
    return ranked.select(*segments.columns, "priority")


def assign_segments(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """(job_id, segment_id, node_id, slot_rank): pending segments put on free slots.

    Jobs in job_id order, the hardest segment first, the strongest node first; what is ranked past the last free
    slot stays pending. Only segments that reach a free slot are ranked, and about a thousandth of the last
    job they reach. A node's slots are listed one by one, so
    this is an equality on the slot number: no range predicate and exactly one match.
    """
    ranges = node_slot_ranges(nodes)
    wanted = pending.select("job_id", "segment_id", "complexity_estimate")
    ranked = slices.global_rank(_reachable(wanted, ranges), pending_order(), "slot_rank")
    slots = ranges.select("node_id", F.explode(F.sequence("first_slot", "last_slot")).alias("slot_rank"))
    return ranked.join(slots, "slot_rank").select("job_id", "segment_id", "node_id", "slot_rank")


def _reachable(pending: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pending segments of the jobs, in order, up to the one in which the free slots run out, and of that the hardest.

    A few single values come back to the driver; the filter they make reaches the scan of the segments.
    """
    slots = ranges.agg(F.max("last_slot")).first()[0]
    if slots is None:
        return pending.where(F.lit(False))
    per_job = pending.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    summed = slices.global_running_sum(slices.range_slices(per_job, [F.col("job_id")]), F.col("_n"), "_upto")
    last = summed.where(F.col("_upto") >= slots).agg(F.min(F.struct("job_id", "_upto", "_n")).alias("l")).first()["l"]
    if last is None:
        return pending
    hardest = _hardest(pending.where(F.col("job_id") == F.lit(last.job_id)), slots - (last._upto - last._n))
    return pending.where((F.col("job_id") < F.lit(last.job_id)) | ((F.col("job_id") == F.lit(last.job_id)) & hardest))


def _cuts_around(values: DataFrame, wanted: int) -> tuple:
    """(low, high, beyond): quantiles of ``values(v)`` with ``wanted`` values above low, fewer, ``beyond``, above high.

    ``low`` is None where only all values are enough, ``high`` where no value is. Quantiles are approximate, the counts that
    choose among them are exact; both are CELLS values at most.
    """
    depths = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    cuts = values.agg(F.percentile_approx("v", depths, F.lit(CELLS * 8)).alias("c")).first()["c"]
    if cuts is None:
        return None, None, 0
    held = F.array(*[F.lit(c) for c in cuts])
    above = [0] * (CELLS + 1)
    passed = slices.cuts_passed(held, F.col("v"), CELLS)  # the cuts below a value
    for row in values.where(F.col("v").isNotNull()).groupBy(passed.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        above[row["cell"]] = row["n"]
    for cell in range(CELLS - 1, -1, -1):
        above[cell] += above[cell + 1]
    # above[i + 1] values lie beyond cuts[i]
    enough = [i for i in range(CELLS - 1) if above[i + 1] >= wanted]
    low = cuts[enough[-1]] if enough else None
    at = enough[-1] + 1 if enough else 0
    return (low, cuts[at], above[at + 1]) if at < CELLS - 1 else (low, None, 0)


def _hardest(segments: DataFrame, wanted: int) -> Column:
    """A condition that the first ``wanted`` segments of one job in their order meet, and few more: what lies in a cell."""
    value, place = F.col("complexity_estimate"), -F.col("segment_id").cast("bigint")
    low, high, beyond = _cuts_around(segments.select(value.alias("v")), wanted)
    if high is not None:
        equal = segments.where(value == F.lit(high))
        if beyond + equal.count() >= wanted:  # the last of them is one of many equals, of which the first in place count
            least, _, _ = _cuts_around(equal.select(place.alias("v")), wanted - beyond)
            first = F.lit(True) if least is None else place > F.lit(least)
            return (value > F.lit(high)) | ((value == F.lit(high)) & first)
    return F.lit(True) if low is None else value > F.lit(low)


def pending_segments(segments: DataFrame, latest: DataFrame) -> DataFrame:
    """Segments without a state: neither assigned nor completed nor failed."""
    return segments.join(latest, ["job_id", "segment_id"], "left_anti")


def requeue_from_dead(latest: DataFrame, dead: DataFrame, segments: DataFrame) -> DataFrame:
    """The original descriptors of segments assigned to a dead node."""
    stranded = (
        latest.where(F.col("kind") == "assign")
        .join(dead.select("node_id"), "node_id", "left_semi")
        .select("job_id", "segment_id")
    )
    return segments.join(stranded, ["job_id", "segment_id"], "left_semi")


def job_nodes(latest: DataFrame) -> DataFrame:
    """(job_id, nodes): sorted distinct nodes a job's segments are on; as many entries as there are nodes."""
    held = latest.where(F.col("kind") == "assign").select("job_id", "node_id").distinct()
    return held.groupBy("job_id").agg(F.sort_array(F.collect_list("node_id")).alias("nodes"))


def current_leader(nodes: DataFrame) -> DataFrame:
    """(node_id) of the live node with the highest priority: the first 16 hex digits of its id."""
    digits = F.substring(F.lower(F.replace(F.col("node_id").cast("string"), F.lit("-"))), 1, 16)
    live = nodes.where(F.col("status") != "Dead")
    return live.agg(F.max_by("node_id", F.struct(digits, F.col("node_id"))).alias("node_id"))


def cluster_status(nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: leader, node count, running jobs, total cores and memory.

    ``jobs(job_id, state)``; both sides are single aggregate rows before they meet.
    """
    memory = F.col("memory_mb") if "memory_mb" in nodes.columns else F.lit(0)
    digits = F.substring(F.lower(F.replace(F.col("node_id").cast("string"), F.lit("-"))), 1, 16)
    leader = F.max_by(
        "node_id", F.when(F.col("status") != "Dead", F.struct(digits.alias("digits"), F.col("node_id").alias("id")))
    )
    node_side = nodes.agg(
        leader.alias("master"),
        F.count(F.lit(1)).alias("nodes"),
        F.coalesce(F.sum("cpu_cores"), F.lit(0)).cast("bigint").alias("cores"),
        F.coalesce(F.sum(memory), F.lit(0)).cast("bigint").alias("memory_mb"),
    ).withColumn("_one", F.lit(1))
    job_side = jobs.agg(F.count_if(F.col("state") == "Processing").alias("active_jobs")).withColumn("_one", F.lit(1))
    return node_side.join(job_side, "_one").select(
        "master", "nodes", "active_jobs", "cores", (F.col("memory_mb") / 1024.0).alias("memory_gb")
    )
