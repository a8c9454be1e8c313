"""Imports every query module, so that the registry is filled."""

from gopmill.plans import cluster_queries, io_queries, media_queries, scalar_queries, stream_queries  # noqa: F401
from gopmill.plans.registry import ORACLES, QUERIES  # noqa: F401
