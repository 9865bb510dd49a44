"""The pipeline: each stage does to its own input what the operator promises."""

from __future__ import annotations

import random

from tests.llm import cases
from tests.llm.test_near_dup import brute as brute_components
from tests.llm.test_streams import brute_hits
from tests.llm.test_substring import brute as brute_spans


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    rows = [r for r in cases.documents(9, 80) if r[1] is not None]
    passage = " ".join(f"p{i}" for i in range(60))
    item = " ".join(f"item{i}" for i in range(30))
    base = 300
    for i in range(40):
        own = [f"u{rng.randrange(10**7)}" for _ in range(80)]
        rows.append((base + i, " ".join([*own[:40], *([passage] if i % 4 == 0 else []), *([item] if i % 7 == 0 else []), *own[40:]]), "en", f"s{i % 3}", 1))
    rows += [(400 + i, " ".join(f"j{rng.randrange(10**3)}###$$$%%%" for _ in range(400)), "en", "s1", 1) for i in range(5)]
    rows.append((390, rows[-10][1], "en", "s1", 1))
    rows.append((500, None, None, None, None))
    spark.createDataFrame(rows, cases.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    start, good, single, spans, clean, mixed = ([tuple(r) for r in x] for x in seen)
    kept = {r[0] for r in good}
    assert not kept & {500, *range(400, 405)} and kept >= {*range(base, base + 40)} and len(start) > len(good)
    groups = brute_components(good)
    assert {r[0] for r in single} == {k for k, v in groups.items() if k == v}
    want = brute_spans(single)
    assert {r[0]: cases.space_words(r[1]) for r in spans} == {k: v[3] for k, v in want.items() if v[3] or not v[0]}
    assert sum("p30" in r[1] for r in spans) == 1
    for r in clean:
        assert brute_hits(cases.mark_words(r[1]), [(1, cases.mark_words(item))])[0] == 0
    assert len(clean) == len(spans)
    assert {r[0] for r in mixed} <= {r[0] for r in clean} and all(1 <= r[-1] <= 2 for r in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)
