"""Address checks, download grants, once-only ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gopmill.functions import net
from gopmill.operators.rangejoin import spread_hot


def blocked_range_table(spark: SparkSession) -> DataFrame:
    """(range, first_ip, last_ip) of the blocked IPv4 ranges: seven rows."""
    return spark.createDataFrame(net.blocked_ipv4_bounds(), "range string, first_ip bigint, last_ip bigint")


def blocked_ranges(addresses: DataFrame) -> DataFrame:
    """Addresses inside a blocked IPv4 range, with that range. The range table has a fixed seven rows."""
    table = F.broadcast(blocked_range_table(addresses.sparkSession))
    numbered = addresses.withColumn("_ip", net.ipv4_number(F.col("address")))
    return numbered.join(table, F.col("_ip").between(F.col("first_ip"), F.col("last_ip"))).select(
        *addresses.columns, "range"
    )


def host_allowed(addresses: DataFrame, ipv4_only: bool = False) -> DataFrame:
    """(host_id, answers, allowed): every answer must be public; a host without any has no row to allow it."""
    public = net.is_public_ipv4 if ipv4_only else net.is_public_address
    return addresses.groupBy("host_id").agg(
        F.count("address").alias("answers"),
        (F.bool_and(public(F.col("address"))) & (F.count("address") > 0)).alias("allowed"),
    )


def redeem_grants(
    grants: DataFrame, attempts: DataFrame, ttl_secs: int = 60, rows_per_task: int | None = None
) -> DataFrame:
    """Attempts with ``redeemed``: the first attempt in time, for the same job and file, that meets its grant.

    ``grants(ticket, job_id, filename, issued_at)`` with unique tickets; ``attempts(attempt_id, ticket, job_id,
    filename, ts)`` with unique ids. The winners are a minimum per ticket, reduced before the shuffle. Both joins are
    by ticket alone, so attempts that lie by ticket already are not shuffled again; a ticket tried very often is left to
    the adaptive skew join, or dealt out with ``rows_per_task``.
    """
    terms = grants.select("ticket", F.col("job_id").alias("_job"), F.col("filename").alias("_file"), "issued_at")
    expires = F.col("issued_at") + F.make_dt_interval(secs=F.lit(ttl_secs))
    tried, granted, on = spread_hot(attempts, terms, ["ticket"], rows_per_task)
    met = (
        (F.col("job_id") == F.col("_job")) & (F.col("filename") == F.col("_file"))
        & (F.col("ts") >= F.col("issued_at")) & (F.col("ts") < expires)
    )
    # inside the aggregate: as a filter its equalities would become join keys, and the attempts be shuffled by them
    first = F.min(F.when(met, F.struct("ts", "attempt_id")))
    winners = tried.join(granted, on).groupBy("ticket").agg(first.alias("_first")).select("ticket", F.col("_first.attempt_id").alias("_won"))
    tried, won, on = spread_hot(attempts, winners, ["ticket"], rows_per_task)
    return tried.join(won, on, "left").select(
        *attempts.columns, F.coalesce(F.col("attempt_id") == F.col("_won"), F.lit(False)).alias("redeemed")
    )


def ingest_sources_once(attempts: DataFrame) -> DataFrame:
    """The first successful attempt of each upload; failed attempts may be retried and never count.

    ``attempts(upload_id, seq, ok, ...)``.
    """
    rest = [c for c in attempts.columns if c not in ("upload_id", "seq")]
    first = F.min(F.struct("seq", *rest)).alias("_first")
    return attempts.where(F.col("ok")).groupBy("upload_id").agg(first).select("upload_id", "_first.*")
