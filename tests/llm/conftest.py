import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, spans string, first long, key string"


def _texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma,", "delta", "été", "Straße", "x1", "***", "|", "ONE!!", "中文", "don't", "<|endoftext|>"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    passage = prose(80)
    base = prose(120)
    near = base.replace("alpha", "omega", 2)
    out = [None, "", " \n\t ", "one", "a b c", base, base, near, base + " tail words here", prose(30) + "\n" + passage + "\n" + prose(30), passage, prose(5) + " " + passage]
    out += ["The The The The " * 60, "x" * 30_000, "line one\nline one\n\n  two   spaces \n", "ab" * 400 + " end", prose(3000), "\x00nul \x1c odd   wide", "▁mark ▁ and  spaces\n"]
    out += [prose(rng.randint(1, 60)) for _ in range(25)]
    return out


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty and long texts, ties and repeated rows."""
    out = [(k * 3 + 1, t) for k, t in enumerate(_texts())]
    return [*out, out[5], (None, "text without an id, of a few words"), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "z", -1, "k") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
