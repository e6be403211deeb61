"""A quick spread of registered cases against DuckDB; check_cases.py runs them all."""

import pytest

import __spark_entry__ as entry_module
from gradloom.suite import load_cases
from gradloom.suite.checks import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = """vec_add mat_zip_map_keyed vec_div_by_zero vec_norm vec_dense_blocks map_blocks_keyed distribute_targets
validate_vector score_linear score_linear_spread linear_l2 loss_quantile forward_binlog linear_softmax softmax_jacobian
fm_backprop fm_pair_ranking gen_ranked_positives gen_sparse_examples label_by_softmax_draw batch_hold_release
next_features vec_from_rows mat_from_rows ot_dual ot_entropy_small_tiles ot_line_probe lbfgs_direction pseudo_gradient
sgd lbfgs_fixed_steps owlqn_fixed_steps search_strong_wolfe state_save_resume""".split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUICK)
def test_case_equals_sql(spark, con, name):
    _, _, problem = compare(spark, con, load_cases()[name], SF)
    spark.catalog.clearCache()
    assert problem is None


def test_driver_contract(spark):
    assert load_cases().keys() <= entry_module.queries().keys()
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()
    assert set(entry_module.entry(spark).columns) == {"idx", "g", "value"}
