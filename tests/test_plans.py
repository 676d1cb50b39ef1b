"""Plans: group limits, no products, pruned and filtered scans."""

import pytest

from waymark import catalog

catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["image_landmark_index", "rank_weighted_votes", "best_per_landmark"])
def test_group_limit(spark, data, name):
    assert "WindowGroupLimit" in plan(catalog.QUERIES[name](spark, data))


@pytest.mark.parametrize("name", ["covisibility_pairs", "nearest_timestamp_join", "topk_within_images", "nearest_keypoint_radius", "p4_found", "p6_found"])
def test_no_products(spark, data, name):
    text = plan(catalog.QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_what_is_needed(spark, data):
    text = plan(catalog.QUERIES["p6_found"](spark, data))
    assert "reproj_error" not in text and "PushedFilters: [IsNotNull(frame_id)" in text
    text = plan(catalog.QUERIES["p3_found"](spark, data))
    assert "file_name" not in text and "loaded_at" not in text
