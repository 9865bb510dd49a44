"""Language ID: the fusion against plain arithmetic, held-out accuracy, awkward rows."""

from __future__ import annotations

import math
import random

import numpy as np

from tests.llm import cases
from tributary.llm import langid

SYLLABLES = {"aa": "ka lo mi tu re", "bb": "schu berg lich ung den", "cc": "eau oi ment que les"}


def text(rng: random.Random, lang: str, n: int) -> str:
    own = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_evidence(spark):
    rng = random.Random(0)
    rows = [(i, text(rng, lang, rng.randrange(5, 60)), lang, f"s{i % 4}", 0) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=200))]
    pages, truth = [], {}
    for i in range(120):
        lang = rng.choice(list(SYLLABLES))
        truth[i] = lang
        body = text(rng, lang, rng.randrange(4, 30)) if i % 5 else ""
        pages.append((i, f"https://{lang}.site{i % 7}.{lang[0]}x/p?q=1", f"<!DOCTYPE html><html class=x lang='{lang.upper()}-XX'><script>var x='{text(rng, 'bb', 40)}'</script><p>{body}</p></html>"))
    got = langid.op1(spark, cases.frame(spark, rows), spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 320
    by_page = {r.page_id: r for r in got if r.page_id is not None}
    assert all(by_page[i].lang == lang for i, lang in truth.items())  # also of pages without a text
    assert all(r.declared == truth[r.page_id] and r.host.startswith(truth[r.page_id]) for r in by_page.values())
    by_doc = {r.doc_id: r.lang for r in got if r.doc_id is not None}
    assert sum(by_doc[k] == lang for k, _, lang, *_ in rows) / len(rows) > 0.98
    assert all(0 <= r.confidence <= 1.0000001 for r in got)


def test_fusion_by_hand(spark):
    langs = ["aa", "bb"]
    rng = np.random.default_rng(1)
    rows = []
    for i in range(30):
        ll = rng.normal(size=2).tolist()
        e = np.exp(ll)
        rows.append((i, ["h1", "h2", None][i % 3], ["s1", None, "s2"][i // 3 % 3], ["com", "de", None][i // 2 % 3], ["aa", None][i % 2], ll, (e / e.sum()).tolist()))
    df = spark.createDataFrame(rows, "id long, host string, site string, suffix string, declared string, ll array<double>, post array<double>")
    got = {r.id: r for r in langid.fused(df, langs).collect()}
    total = np.sum([r[6] for r in rows], axis=0)
    prior = (total + 1) / (total.sum() + 2)
    for i, host, site, suffix, declared, ll, post in rows:
        def others(place, value):
            return np.sum([r[6] for r in rows if value is not None and r[place] == value], axis=0) - np.array(post) if value is not None else np.zeros(2)

        s = (others(2, site) + 5 * prior) / (others(2, site).sum() + 5)
        h = (others(1, host) + 5 * s) / (others(1, host).sum() + 5)
        log = np.array(ll) + np.log(h)
        for place, value, kinds in ((3, suffix, 2), (4, declared, 1)):
            if value is not None:
                log += np.log((others(place, value) + 1) / (total + kinds + 1))
        assert got[i].lang == langs[int(log.argmax())]
        assert math.isclose(got[i].confidence, 1 / np.exp(log - log.max()).sum(), rel_tol=1e-9)


def test_awkward_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "not a url", "<p>"), (2, "//x", "ka lo")], "page_id long, url string, html string")
    docs = cases.frame(spark, [(1, None, None, None, None), (2, "", "aa", None, 0), (3, "ka lo mi", "aa", "s", 0)])
    got = langid.op1(spark, docs, pages).collect()
    assert len(got) == 6 and {r.lang for r in got} == {"aa"}
    none = langid.op1(spark, docs.limit(0), pages).collect()
    assert len(none) == 3 and {r.lang for r in none} == {None}
