"""Registered queries against their checking statements on the smallest tables."""

import pytest

from edurank.workload.catalog import REGISTRY
from edurank.workload.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# The complete set is compared at a larger scale outside the unit tests.
NAMES = [
    "rate_default",
    "rate_thresholds_all",
    "rate_institute_and_subjects",
    "program_school_match",
    "search_all_subjects",
    "search_profiles_paged",
    "card_periods",
    "subject_heat",
    "subject_compare",
    "exam_sanitize",
    "ffill_blocks",
    "dup_groups",
    "merge_subject_stats",
    "integrity_violations",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    result = compare(spark, con, name, SF_DIR)
    assert result["ok"], result["note"]


def test_every_query_has_a_statement():
    assert not [n for n, q in REGISTRY.items() if q.oracle is None]
