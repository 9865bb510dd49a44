"""Quality rules: statistics against brute force, verdicts on planted junk."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tests.llm import cases
from tributary.llm import quality


def brute(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = cases.space_words(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if cases.space_words(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_repeated_words_of_long_texts(spark):
    seeded = random.Random(6)
    once = [str(seeded.randrange(10**9)) for _ in range(20000)]
    texts = [" ".join(once), " ".join(once + once), " ".join(once + ["x"] + once[100:104] + ["y"] + once[200:206]), "a " * 3000, "a b c d e", "a b c d e a b c d e"]
    got = quality.with_statistics(cases.frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)]), carried=["doc_id"])
    assert {r.doc_id: r.n_repeat_words for r in got.select("_doc.doc_id", "n_repeat_words").collect()} == {k: brute(t)[4] for k, t in enumerate(texts)}


def test_statistics_and_base_rule(spark):
    rows = cases.documents() + [(500, "a b c d e\n" * 3 + "x # | <y> z", "en", "s", 1), (500, "a b c d e\n" * 3, "en", "s", 1), (501, "  é x\x1cy", None, None, 2)]
    docs = cases.frame(spark, rows).selectExpr("*", "'clash' as kept", "5 as n_words")
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    want = Counter((k, *brute(t)) for k, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.op6(cases.frame(spark, rows).limit(0)).count() == 0


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(12, 400))]
        junk = i % 9 == 0
        rows.append((i, " ".join(w + rng.choice(["###", "$$$", "%%%"]) * junk for w in words), "en" if i % 2 else "de", f"s{i % 3}" if i > 30 else f"rare{i}", 0))
    got = {r.doc_id: r for r in quality.quality(cases.frame(spark, rows)).collect()}
    for i in range(400):
        if not got[i].base_failed and (i % 9 or got[i].n_words >= 60):  # rates of short texts say little
            assert got[i].kept == bool(i % 9), (i, got[i].distance, got[i].n_words)
    kept = quality.stage(cases.frame(spark, rows))
    assert kept.columns == cases.frame(spark, rows).columns and kept.count() == sum(r.kept for r in got.values())


def test_short_junk_goes_too(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(12, 400))]
        junk = i % 9 == 0
        rows.append((i, " ".join(w + rng.choice(["###", "$$$", "%%%"]) * junk for w in words), "en" if i % 2 else "de", f"s{i % 3}" if i > 30 else f"rare{i}", 0))
    got = {r.doc_id: r for r in quality.quality(cases.frame(spark, rows)).collect()}
    for i in range(400):
        if not got[i].base_failed:
            assert got[i].kept == bool(i % 9), (i, got[i].distance, got[i].n_words)


def plain(z, keep):
    """The determinant of the rows that are kept, with what is known before."""
    own = z[list(keep)]
    share = len(own) / (len(own) + quality.PRIOR_ROWS)
    c = share * np.cov(own.T, bias=True) + np.diag((1 - share) * np.square(quality.PRIOR) + np.square(quality.FLOORS))
    return np.linalg.det(c), own.mean(0), c


def frame_of(spark, groups):
    return spark.createDataFrame([(g, *map(float, r)) for g, z in groups.items() for r in z], "g string, z0 double, z1 double, z2 double, z3 double")


def test_determinant_of_tiny_groups_is_the_least_of_all_halves(spark):
    rng = np.random.default_rng(4)
    groups = {}
    for k, n in enumerate((2, 5, 8, 11)):
        z = rng.normal(0, 0.1, (n, 4))
        z[: n // 3] += rng.normal(0, 2, 4)  # less than half are elsewhere
        groups[f"g{k}"] = z - np.median(z, 0)
    got = {r.g: r.det for r in quality.estimates(frame_of(spark, groups)).collect()}
    for g, z in groups.items():
        least = min(plain(z, s)[0] for s in combinations(range(len(z)), -(-len(z) // 2)))
        assert least * 0.999 <= got[g] <= least * 1.25, (g, got[g], least)


def test_determinant_of_larger_groups_against_many_random_starts(spark):
    rng = np.random.default_rng(9)
    mixed = rng.normal(0, 1, (4, 4)) * 0.2
    z = rng.normal(0, 1, (400, 4)) @ mixed
    z[:120] = rng.normal(3, 0.05, (120, 4))  # a tight cloud of outliers
    groups = {"a": z - np.median(z, 0), "b": rng.normal(0, 0.3, (151, 4))}
    got = {r.g: r for r in quality.estimates(frame_of(spark, groups)).collect()}
    for g, z in groups.items():
        best = None
        for _ in range(60):
            keep = rng.choice(len(z), 6, replace=False)
            last = None
            while True:
                det, m, c = plain(z, keep)
                if last is not None and det >= last * (1 - 1e-9):
                    break
                last = det if len(keep) > 6 else None
                d = z - m
                keep = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))[: -(-len(z) // 2)]
            best = min(best or det, det)
        assert best * 0.98 <= got[g].det <= best * 1.15, (g, got[g].det, best)


def test_columns_of_any_name_pass(spark):
    rows = cases.documents()
    docs = cases.frame(spark, rows).selectExpr("*", *(f"{k} as `{x}`" for k, x in enumerate(["scale", "rows", "g", "z0", "m0", "l00", "_doc", "_lang", "x1", "d2", "n_words", "kept", "_whole", "start"])))
    got = quality.stage(docs)
    assert got.columns == docs.columns and {r.n_words for r in got.collect()} == {10}
    assert quality.quality(docs).count() == len(rows)


def test_generated_code_compiles(spark):
    """Where code generation fails, Spark interprets and only logs it; here it raises."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.codegen.fallback", "spark.sql.codegen.factoryMode")}
    try:
        spark.conf.set("spark.sql.codegen.fallback", "false")
        spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
        assert quality.quality(cases.frame(spark, cases.documents())).count() == 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_inverse_by_minors_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for _ in range(20):
        a = rng.normal(0, 1, (4, 4)) * rng.choice([0.01, 1, 5], 4)[:, None]
        c, y = a @ a.T + np.diag(np.square(quality.FLOORS)), rng.normal(0, 1, 4)
        rows.append([float(x) for x in (*(c[i, j] for i, j in quality.LOWER), *y)])
        want.append((np.linalg.det(c), y @ np.linalg.solve(c, y)))
    frame = spark.createDataFrame(rows, ", ".join([f"c{i}{j} double" for i, j in quality.LOWER] + [f"y{i} double" for i in range(4)]))
    cofactors, det = quality.adjugate({(i, j): F.col(f"c{i}{j}") for i, j in quality.LOWER})
    got = frame.select(det.alias("det"), (quality.quadratic(cofactors, [F.col(f"y{i}") for i in range(4)]) / det).alias("d2")).collect()
    for r, (d, q) in zip(got, want, strict=True):
        assert abs(r.det - d) <= 1e-6 * abs(d) and abs(r.d2 - q) <= 1e-5 * abs(q)
