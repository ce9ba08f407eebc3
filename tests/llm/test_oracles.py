"""Training-data queries beside their SQL on the smallest tables."""

import os

import pytest

from foliograph.llm import catalog
from oracle import same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    same(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])
