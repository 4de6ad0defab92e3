"""Deprecation-usage analytics on Spark: which deprecated APIs, packages and models a fleet of
repositories uses, where, how urgent each use is, and which repositories should fail a gate."""

from duskwatch.plans.scan import ScanResult, scan
from duskwatch.session import build_session, configure
from duskwatch.sources.registry import load_registry, read_registry, registry_from_rows

__all__ = [
    "ScanResult", "build_session", "configure", "load_registry", "read_registry",
    "registry_from_rows", "scan",
]
