import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, node long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents with copies, near copies, shared passages, odd texts and clashing columns."""
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ba", "né", "tor", "ing", "ST", "x") for b in range(60)]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, texts = some(70), [None, "", " \n\t ", "one", "One", "one two three four", "a b c d e", "a" * 400, "é" * 120, "🙂 " * 60]
    for n in (6, 9, 14, 30, 60, 150, 400):
        base = some(n)
        for changed in (0, 0, 1, 1, 2):
            w = list(base)
            for _ in range(changed * max(1, n // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        texts.append(" ".join([*base, *passage]))
        texts.append(" ".join([*some(n), *passage, *some(3)]))
    texts += ["same line here\n" * 12, " ".join(["the cat sat"] * 40), " ".join(some(3000))]
    rows = [(i, t, "en" if i % 2 else None, "s", 0, 0.5, "k", 7) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def pairs(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Null and repeated ids, repeated rows."""
    text = " ".join(f"w{i}" for i in range(80))
    return spark.createDataFrame([(None, text), (None, None), (5, text), (5, text), (9, text + " end")], "doc_id long, text string")
