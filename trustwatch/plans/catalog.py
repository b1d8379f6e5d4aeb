"""Imports every query module so that the registry is complete."""

import importlib
import importlib.util

from trustwatch.plans.registry import ORACLES, QUERIES

MODULES = ["q_select", "q_schema", "q_batches", "q_profile", "q_quality", "q_rules", "q_trust", "q_baseline", "q_detect",
           "q_events", "q_diagnose", "q_assess", "q_monitor", "q_audit", "q_sources"]

for _m in MODULES:
    if importlib.util.find_spec(f"trustwatch.plans.{_m}"):
        importlib.import_module(f"trustwatch.plans.{_m}")

__all__ = ["QUERIES", "ORACLES"]
