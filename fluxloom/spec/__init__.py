"""Pipelines as documents: text -> checked resources.  Only ``Workspace.check_types`` needs a Spark session."""

from fluxloom.spec.documents import Resource, canonical, content_hash, interpolate, load
from fluxloom.spec.rules import Workspace

__all__ = ["Resource", "Workspace", "canonical", "content_hash", "interpolate", "load"]
