"""The licence scan as a whole against matches found by trying every place."""

from __future__ import annotations

import random
import time

from tests.llm import cases
from tributary.llm import licenses

TEMPLATES = {"one": " ".join(f"w{i % 11} v{i}" for i in range(30)), "two": " ".join(f"w{i % 7}" for i in range(25)) + " end of two", "three": " ".join(f"v{i}" for i in range(12))}
PHRASES = {"end of": "base", "w1 w2 w3": "more", "End  of": "also"}


def brute(text: str | None) -> tuple:
    words = cases.mark_words(text)
    templates = {k: cases.mark_words(t) for k, t in TEMPLATES.items()}
    everything = [*templates.values(), *(cases.mark_words(p) for p in PHRASES)]

    def within(run):
        return any(s[i : i + len(run)] == run for s in everything for i in range(len(s) - len(run) + 1))

    longest = [max(n for n in range(i + 2) if n == 0 or within(words[i + 1 - n : i + 1])) for i in range(len(words))]
    long = []
    for i, n in enumerate(longest):
        if n >= licenses.LONG and (i + 1 == len(words) or longest[i + 1] <= n):
            run = words[i + 1 - n : i + 1]
            long += [(k, t, i + 1 - n, n) for k, s in enumerate(templates.values()) for t in range(len(s) - n + 1) if s[t : t + n] == run]
    chains = []
    for k, t, f, n in sorted(long, key=lambda x: (x[0], x[2], x[1])):
        fits = [c for c in chains if c[0] == k and -n < f - c[3] <= licenses.MAX_GAP and -n < t - c[4] <= licenses.MAX_GAP and t + n > c[4] and f + n > c[3]]
        if not fits:
            chains.append([k, n, f, f + n, t + n])
            continue
        best = max(fits, key=lambda c: c[1])  # the first of those that cover most
        fresh = n - max(0, best[4] - t, best[3] - f)
        if fresh > 0:
            best[1], best[3], best[4] = best[1] + fresh, f + n, t + n
    names, sizes = list(templates), [len(s) for s in templates.values()]
    spans = sorted((names[k], s, e, min(1.0, n / sizes[k])) for k, n, s, e, _ in chains)
    base = sorted((i, label) for p, label in PHRASES.items() for q in [cases.mark_words(p)] for i in range(len(words)) if words[i : i + len(q)] == q)
    labels = {x for _, x in base} | {name for name, _, _, c in spans if c >= licenses.MIN_COVERAGE}
    score = 1.0 if base else max([0.0, *(c for *_, c in spans)])
    return len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9), spans


def test_whole_result(spark):
    rng = random.Random(3)
    parts = [cases.mark_words(t) for t in TEMPLATES.values()]
    texts: list[str | None] = [None, "", "end of", *TEMPLATES.values()]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            s = rng.choice(parts)
            a = rng.randrange(len(s))
            words += s[a : a + rng.randrange(1, 30)] + [f"x{rng.randrange(5)}" for _ in range(rng.choice([0, 0, 1, 9, 12]))]
        texts.append(" ".join(words))
    docs = cases.frame(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)]).selectExpr("*", "1 as score", "2 as labels")
    for r in licenses.licence_scan(docs, templates=TEMPLATES, phrases=PHRASES).collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), sorted(map(tuple, r.spans)))
        assert got == brute(texts[r.doc_id]), (r.doc_id, texts[r.doc_id])
    assert licenses.licence_scan(docs, templates={}, phrases=PHRASES).where("size(spans) > 0").count() == 0
    assert licenses.licence_scan(docs.limit(0)).count() == 0


def test_thousands_of_notices_take_linear_time():
    t = licenses.Templates({"one": TEMPLATES["one"]}, {})
    notice = licenses._words(TEMPLATES["one"])
    began = time.perf_counter()
    _, long = t.scan((notice + [b"zz"] * 20) * 2000)
    assert len(licenses.chained(long)) >= 2000 and time.perf_counter() - began < 20
