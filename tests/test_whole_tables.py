"""Queries over whole tables against DuckDB, and that they see rows which their filtered twins leave out."""

import pytest

from gradloom.suite import load_cases
from gradloom.suite.checks import compare, duck

NAMES = ["gen_ranked_positives", "validate_vector", "vec_from_rows", "link_violations"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_table(spark, name):
    # Links that have orders of status P alone are found in the larger tables only.
    sf = f"/root/testdata/sf{0.1 if name == 'link_violations' else 0.001}"
    cases = load_cases()
    _, _, problem = compare(spark, duck(sf), cases[f"{name}_all"], sf)
    assert problem is None
    whole, part = (set(cases[n].run(spark, sf).collect()) for n in (f"{name}_all", name))
    assert whole - part
