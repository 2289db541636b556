import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, node string, spans string"


@pytest.fixture(scope="session")
def texts():
    """Small corpus with copies, near copies, nulls, empty and odd texts, a hot source, repeated ids."""
    draw = random.Random(12)
    words = {"en": "the of and with that house river stone green water light".split(), "fr": "le la des avec maison rivière pierre verte lumière été".split()}
    out = []
    for i in range(160):
        lang = "en" if i % 2 else "fr"
        out.append((i, " ".join(draw.choice(words[lang]) + draw.choice(["", "", "s", "ly,"]) for _ in range(draw.choice([3, 30, 120]))), lang))
    for i in range(160, 190):  # near copies of one text, and exact ones
        base = out[1 + 2 * (i % 3)][1].split()
        if i % 2 and len(base) > 20:
            base[draw.randrange(len(base))] = f"changed{i}"
        out.append((i, " ".join(base), "en"))
    out += [(190, None, "en"), (191, "", None), (192, " \n\t ", "en"), (193, "1234 5678 !!", "fr"), (194, "one", "en"), (195, "x" * 5000, "en"), (None, "a text without an id that is long enough", "en"), (None, None, None), (7, "a second text under id seven, long enough to count", "en")]
    out += [(196, "mail a.b@c.org, 10.0.0.256 10.0.0.25, 4539 1488 0343 6467, +44 (20) 7946-0958 ok", "en"), (197, "same ws words here again and again", "en"), (198, "SAME  ws\twords here again and again", "en")]
    return [(k, t, lang, [None, "hot", "hot", "b", "c"][i % 5], 0, 1, "x", "y", "z") for i, (k, t, lang) in enumerate(out)]


@pytest.fixture()
def docs(spark, texts):
    """With extra columns whose names clash with those of the operators."""
    return spark.createDataFrame(texts, KINDS)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], KINDS)
