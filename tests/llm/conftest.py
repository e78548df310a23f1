import random

import pytest

ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, stats string, fp string, rest string, found string, component_id string, n_words string, tile_a string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text: random, empty, blank, one word, very long, copies, near copies, shared passages, foreign letters."""
    rng = random.Random(4)
    shared = words(rng, 60)
    out = {i: words(rng, rng.randrange(1, 120)) for i in range(40)}
    out |= {40: "", 41: " \n\t ", 42: "one", 43: words(rng, 9000), 44: out[3], 45: out[3], 46: out[3] + " tail", 47: words(rng, 30) + " " + shared + "\n" + words(rng, 10), 48: words(rng, 5) + "  " + shared, 49: shared + " " + shared}
    return out | {50: "Grüße  an\tdie 漢字, Straße!\n\nZeile zwei 🤗 don't I'll. ", 51: "a" * 400, 52: "THE the The % # <b> $5", 53: words(rng, 200, 3), 54: "x " * 70}


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with a null text, null ids, a repeated row and extra columns of clashing names."""
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 4}", len(t)) for i, t in texts.items()]
    rows += [(60, None, None, None, None), (None, texts[3], "en", None, 1), (None, "only here " + texts[1], None, "s", 1), rows[5]]
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], ODD_COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_COLUMNS)


@pytest.fixture(scope="session")
def plain(texts):
    """(doc_id, text) of every row of docs, null text as empty."""
    return [*texts.items(), (60, ""), (None, texts[3]), (None, "only here " + texts[1]), (5, texts[5])]
