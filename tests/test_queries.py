"""Every registered query is complete; a spread of them is compared with its SQL."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from landlens.catalog import load  # noqa: E402
from tools.check import compare, connect  # noqa: E402

ROWS_ONLY = {"q10_clean_documents"}
QUICK = [
    "s2_segmented_scan", "s5_session_log", "s6_district_shapes", "s8_date_table", "p6_declared_casts", "p7_text_to_boolean", "f2_exclusion_keeps_missing",
    "f12_blocked_markers", "f15_backfill_candidates", "j6_date_part_join", "j8_pending_rows", "j9_region_map", "j10_scalar_back_to_rows", "a6_median",
    "a7_percentiles", "a18_box_plot", "a19_matrix_with_total", "a22_date_drill", "a23_outlier_table", "a24_column_profile", "a25_trend_line",
    "w4_peak_marker", "w6_highlight_class", "w8_sequence_key", "w9_first_line_per_order", "k3_top_with_ties_joined", "k4_top_values", "u3_first_seen_links",
    "n9_toward_zero_bins", "c6_c7_price_segment", "d1_impossible_date", "t1_normalize_text", "t4_canonical_key", "t13_number_from_text", "t19_address_split",
    "t25_noise_words", "h2_page_title", "h5_area_and_frontage", "x1_resumable_ingest", "y1_typed_parameters", "y5_reply_parsing", "q1_clean_listings",
    "q5_price_histogram", "q7_outlier_thresholds", "q8_profile_table",
]
NAMES = list(load().QUERIES) if os.environ.get("LANDLENS_ALL") else QUICK


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # the training-data operators have tests of their own
    queries, checks = load().QUERIES, load().CHECKS
    assert set(queries) <= set(entry.queries()) and set(checks) <= set(entry.oracle_sql())
    assert set(queries) - set(checks) == ROWS_ONLY
    families = {name.split("_")[0] for name in queries}
    wanted = (
        [f"s{i}" for i in range(1, 11)] + [f"p{i}" for i in range(1, 13)] + [f"f{i}" for i in range(1, 16)] + [f"j{i}" for i in range(1, 12)]
        + [f"a{i}" for i in range(1, 27)] + [f"w{i}" for i in range(1, 11)] + [f"k{i}" for i in range(1, 9)] + [f"u{i}" for i in range(1, 6)]
        + [f"n{i}" for i in range(1, 11)] + [f"c{i}" for i in (1, 2, 3, 4, 5, 6, 8, 9, 10)] + [f"d{i}" for i in range(1, 6)]
        + [f"t{i}" for i in range(1, 29)] + [f"h{i}" for i in range(1, 14)] + [f"x{i}" for i in range(1, 5)] + [f"y{i}" for i in range(1, 6)]
        + [f"q{i}" for i in range(1, 11)]
    )
    assert set(wanted) - families == set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note
