import os
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, as extra columns of an input.
CLASHING = ("part", "th", "node", "blob", "size", "score", "rank", "n", "kept", "evidence", "peak", "predicted", "held_out", "kept_text", "n_words", "n_removed", "span_starts", "label", "component_id", "toxic", "measures", "trusted", "h", "chunk")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    long = " ".join(f"x{i % 997}" for i in range(30000))
    base = " ".join(f"b{i}" for i in range(40))
    rows = [
        (1, base, "en", "s", 1), (2, base, "en", "s", 1), (3, base + " end", None, None, None), (4, None, "en", "s", None), (5, "", "en", None, 0), (6, " \t\n ", "en", "s", 4),
        (7, long, "en", "s", 1), (8, long + " tail", "en", "s", 1), (9, "one", "en", "t", 3), (9, "one", "en", "t", 3), (10, "ONE", "de", "t", 3), (11, "zwei drei é 日本  x", "de", "t", 3),
        (12, base.upper(), "en", "s", 1), (None, base, "en", "s", 1), (13, "a b c d", "en", "t", 7), (14, "a b c d", "en", "t", 7),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(7).alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def random_docs(spark):
    """300 documents: copies, near copies, shared passages of several lengths, and a hot phrase."""
    rng = np.random.default_rng(5)
    passages = [sentence(rng, n) for n in (9, 12, 13, 14, 30, 60)]
    texts = []
    for i in range(300):
        t = sentence(rng, int(rng.integers(1, 120)))
        kind = i % 6
        if kind == 1 and texts:
            t = texts[int(rng.integers(len(texts)))]
        elif kind == 2 and texts:
            w = texts[int(rng.integers(len(texts)))].split()
            w[int(rng.integers(len(w)))] = f"edit{i}"
            t = " ".join(w)
        elif kind == 3:
            t = f"{t} {passages[int(rng.integers(len(passages)))]} {sentence(rng, 20)}"
        elif kind == 4:
            t = f"{sentence(rng, 15)} h1 h2 h3 h4 h5 h6 {sentence(rng, 15)}"
        texts.append(t)
    ids = rng.permutation(1000)[:300]
    rows = [(int(i), t, "en", f"s{k % 4}", len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)
