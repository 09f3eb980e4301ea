"""Colonnade: business-table analytics as composable Spark DataFrame operators."""

from colonnade.plans.bundles import dashboard
from colonnade.plans.registry import operator_names, run
from colonnade.plans.roles import SemanticProfile, build_semantic_profile, profile_of
from colonnade.sources.tables import read, register_tables, write

__all__ = [
    "SemanticProfile",
    "build_semantic_profile",
    "dashboard",
    "operator_names",
    "profile_of",
    "read",
    "register_tables",
    "run",
    "write",
]
