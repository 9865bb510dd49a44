"""The training-data operators against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.plans.test_oracles import DATA, canon, duck  # noqa: F401
from tributary.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", [k for k in ORACLES if k in ("op11_prefix_trie", "op12_conversation_repair", "op13_html_text")])
def test_oracle(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, DATA)
    got = canon(df.collect(), df.columns)
    rel = duck.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    want = canon(rel.fetchall(), names)
    assert sorted(names) == sorted(df.columns)
    assert got == want, [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
    assert got
