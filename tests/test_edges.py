import pytest

from pilegrain import catalogue
from pilegrain.plans import actions
from tests.edge_tables import write


@pytest.fixture(scope="module")
def empty(sf, tmp_path_factory):
    return write(sf, str(tmp_path_factory.mktemp("empty")), "empty")


@pytest.fixture(scope="module")
def dirty(sf, tmp_path_factory):
    return write(sf, str(tmp_path_factory.mktemp("dirty")), "dirty")


def test_written_times(spark, sf, empty, dirty):
    query = catalogue.QUERIES["p4_found"]
    assert query(spark, empty).collect() == []
    assert sorted(map(tuple, query(spark, dirty).collect())) == sorted(map(tuple, query(spark, sf).collect()))


@pytest.mark.parametrize("name", ["kind_composition", "exact_duplicates", "content_duplicates", "pairwise_scores", "bcubed_scores", "strata", "capped_pool", "latest_decision", "coverage_curve", "pile_ranking", "face_pose", "faces_suppressed", "name_near_duplicates", "piles_components", "greedy_sample"])
def test_empty_tables(spark, empty, name):
    assert catalogue.QUERIES[name](spark, empty).count() in (0, 1)


WRITES = sorted([*actions.QUERIES, "experiment_run", "largest_pile_verdict", "merge_queue", "merge_cut", "closest_pairs", "pile_ranking_coherent", "pile_quality", "worst_people", "split_preview", "pinned_trim", "identity_split", "error_bar", "corpus_warnings", "people_counts", "cross_group_supply", "sweep_thresholds", "random_pairs"])


@pytest.mark.parametrize("name", WRITES)
def test_writes_and_experiments_of_empty_and_dirty_tables(spark, empty, dirty, name):
    assert catalogue.QUERIES[name](spark, empty).count() <= 7
    catalogue.QUERIES[name](spark, dirty).count()


@pytest.mark.parametrize("name", ["exact_duplicates", "pending_photos", "capped_pool", "latest_decision", "pile_ranking", "face_pose", "strata", "per_person"])
def test_repeated_and_null_rows_change_nothing(spark, sf, dirty, name):
    rows = lambda d: sorted(str(r) for r in catalogue.QUERIES[name](spark, d).collect())
    assert rows(dirty) == rows(sf)
