import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, _row string, fp string, kept string"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def nasty(spark):
    """Null ids, texts, labels and sources, empty and long texts, repeated rows, and columns whose names operators use too."""
    rng = random.Random(4)
    en = ["the", "house", "of", "water", "and", "light", "runs", "over", "stone", "quietly", "green", "hill", "under", "seven", "clouds"]
    fr = ["le", "château", "été", "garçon", "où", "très", "déjà", "forêt", "être", "français", "naïve", "noël"]
    rows = []
    for k in range(60):
        rows.append((k, sentence(rng, 80, en) + ".", "en", "a" if k % 2 else "b"))
    for k in range(60, 90):
        rows.append((k, sentence(rng, 70, fr) + ".", "fr", None))
    base = sentence(rng, 200, [f"{w}{i}" for w in en for i in range(30)])
    words = base.split()
    rows += [(90, base, "en", "a"), (91, base, "en", "c"), (92, " ".join(words[:100] + ["changed"] + words[101:]), "en", "c"), (90, base, "en", "a")]
    rows += [(93, None, "en", "a"), (94, "", "fr", "b"), (95, " \n\t ", None, None), (None, "one two three four five six", "en", "a"), (96, "12 34 !?", "en", "a")]
    rows += [(97, sentence(rng, 30000, en), "en", "d"), (98, "x", None, "a"), (99, "\n".join(["same line of words here again"] * 30), "en", "a")]
    full = [(i, t, lg, s, len(t or ""), 0.5, "s", "r", "f", "k") for i, t, lg, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
