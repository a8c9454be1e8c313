"""Flat rows from nested pod status documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POD_LIST_SCHEMA = """struct<items: array<struct<
    metadata: struct<name: string, labels: map<string, string>>,
    status: struct<phase: string, startTime: string,
                   containerStatuses: array<struct<ready: boolean, restartCount: string>>>,
    spec: struct<nodeName: string>>>>"""


def _summary(pod: Column) -> Column:
    states = F.coalesce(pod["status"]["containerStatuses"], F.array())
    ordinal = pod["metadata"]["labels"]["apps.kubernetes.io/pod-index"]
    ordinal = F.when(ordinal != "", ordinal)
    return F.struct(
        pod["metadata"]["name"].alias("name"),
        pod["status"]["phase"].alias("phase"),
        ((F.size(states) > 0) & F.forall(states, lambda s: F.coalesce(s["ready"], F.lit(False)))).alias("ready"),
        F.aggregate(
            states,
            F.lit(0).cast("bigint"),
            lambda total, s: total + F.coalesce(s["restartCount"].try_cast("bigint"), F.lit(0)),
        ).alias("restarts"),
        pod["status"]["startTime"].alias("started_at"),
        F.when(ordinal == "0", "master").otherwise("worker").alias("role"),
        ordinal.alias("ordinal"),
        pod["spec"]["nodeName"].alias("node"),
    )


def pod_summary(documents: DataFrame, text: str = "json") -> DataFrame:
    """One row per pod of each document; an empty or unreadable document gives none."""
    items = F.coalesce(F.from_json(F.col(text), POD_LIST_SCHEMA)["items"], F.array())
    return documents.select(F.explode(items).alias("pod")).select(_summary(F.col("pod")).alias("pod")).select("pod.*")
