"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from catalog.compare import connect, differences
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert differences(duck, QUERIES[name](spark, FOLDER), ORACLES[name]) is None


def test_sample_rows(spark):
    rows = QUERIES["sample_rows"](spark, FOLDER).collect()
    assert len(rows) == 3 and all(len(r["text"]) <= 500 for r in rows)
