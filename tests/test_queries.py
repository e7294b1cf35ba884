"""Every registered query of the reference's operators against its SQL, or, without SQL, as rows."""

from __future__ import annotations

import pytest

from tests.compare import connect, differences
from wayfold.plans import all_oracles, all_queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_equals_sql(spark, sf_dir, con, name):
    assert differences(all_queries()[name](spark, sf_dir), con, all_oracles()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_without_sql(spark, sf_dir, name):
    assert all_queries()[name](spark, sf_dir).count() > 0
