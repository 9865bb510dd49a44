"""Every stage: awkward rows, columns of any name, empty tables, one very long text."""

from __future__ import annotations

import pytest

from tests.llm import cases
from tributary.llm import decontaminate, mixing, near_dup, quality, substring

NAMES = ["size", "source_size", "target", "taken", "n_hit", "spans", "items", "n_words", "n_removed", "_marks", "_doc", "scale", "rows", "z0", "key", "component", "n", "kept", "_whole", "place", "_source", "lo"]


def stages(spark):
    items = spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(12))), (None, None)], "item_id long, text string")
    return {"quality": quality.stage, "near_dup": near_dup.stage, "substring": substring.stage, "decontaminate": lambda d: decontaminate.stage(d, items), "mixing": mixing.stage}


@pytest.mark.parametrize("name", ["quality", "near_dup", "substring", "decontaminate", "mixing"])
def test_stage(spark, name):
    clean = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    rows = [(k, t, "en", "s", k) for k, t in enumerate(clean)]
    rows += [(None, " ".join(f"n{k}x{i}" for i in range(40)), None, None, None) for k in range(2)]  # no id
    rows += [(9, " ".join(f"r{k}x{i}" for i in range(40)), "en", "s", 1) for k in range(2)]  # one id, two texts
    rows += [(20, " ".join(f"l{i}" for i in range(300_000)), "de", "s", 1), (21, None, None, None, None), (22, "", "en", "s", 0)]
    docs = cases.frame(spark, rows)
    wide = docs.selectExpr("*", *(f"{k} as `{x}`" for k, x in enumerate(NAMES)))
    stage = stages(spark)[name]
    got = stage(wide)
    dropped = {"size", "source_size", "target", "taken"} if name == "mixing" else set()
    assert [c for c in got.columns if c in wide.columns and c not in dropped] == [c for c in wide.columns if c not in dropped]
    out = got.collect()
    for k, x in enumerate(NAMES):
        assert x in dropped or {r[x] for r in out} == {k}
    texts = sorted(r.text for r in out if r.text)
    if name == "mixing":
        assert set(texts) <= {r[1] for r in rows} and len(texts) == len(set(texts))
    else:  # clean documents stay, whatever their ids
        assert texts == sorted(r[1] for r in rows if r[1])
    assert stage(wide.limit(0)).count() == 0
