"""Modes at any number of rows."""

from tests.oracle import compare, duck
from trustwatch.plans import catalog


def test_no_task_holds_all_typicalities(spark, sf):
    d = catalog.QUERIES["i1_baseline_modes"](spark, sf)
    assert "percentile(" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert not compare(d, catalog.ORACLES["i1_baseline_modes"], duck(sf))
