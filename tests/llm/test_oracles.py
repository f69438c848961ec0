"""Queries of the training-data operators against their SQL."""

from __future__ import annotations

import pytest

from chronoloom.llm import queries as llm

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_as_sql(spark, name):
    compare(spark, llm.queries()[name], llm.oracle_sql()[name])
