"""Small documents with the awkward cases: nulls, empty texts, ties, copies, odd white space."""

from __future__ import annotations

import random
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text: str | None) -> list[str]:
    return SPACE.findall(text or "")


def mark_words(text: str | None) -> list[str]:
    return MARK.findall(lower(text))


def sentence(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    words = ["The", "the", "Straße", "été", "a-b", "x.y", "1,000", "ñ", "don't", "<|endoftext|>"] + [f"w{i}" for i in range(vocabulary)]
    seps = [" ", " ", " ", " ", "\n", "\t", "  ", " ", "\r\n"]
    return "".join(rng.choice(words) + rng.choice(seps) for _ in range(n))


def documents(seed: int = 7, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    passages = [sentence(rng, 45, 400) for _ in range(4)]
    texts: list[str | None] = [None, "", " \n\t", "one", "a b c d", "tie tie tie tie tie " * 9]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.2 and len(texts) > 8:
            texts.append(rng.choice(texts))  # an exact copy
        elif kind < 0.4 and len(texts) > 8:
            words = (rng.choice(texts) or "").split(" ")
            if words:
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        else:
            parts = [sentence(rng, rng.randrange(1, 90), 400)]
            if rng.random() < 0.5:
                parts.insert(rng.randrange(2), rng.choice(passages))
            texts.append(" ".join(parts))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(parts)
