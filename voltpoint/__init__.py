"""Spark-native ingest, selection and views of space-time point sources."""

from voltpoint.plans.workspace import Workspace
from voltpoint.schema import POINT_SCHEMA, Thresholds

__all__ = ["POINT_SCHEMA", "Thresholds", "Workspace"]
