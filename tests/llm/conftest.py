import random

import pytest

SCHEMA = "doc_id long, text string, source string, n_chars long, row string, copy int, _id string, toxicity double, pos int"
WORDS = [a + b for a in ("al", "be", "cor", "dun", "er", "fol", "gra", "hin", "ös", "ña") for b in ("ta", "ne", "mi", "lo", "ru", "sti")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def messy_rows() -> list[tuple]:
    """Copies, shared lines and passages, nulls everywhere, repeated ids and rows, empty and long texts."""
    rng = random.Random(4)
    shared = [sentence(rng, 14) for _ in range(3)]
    passage = sentence(rng, 30)
    base = [sentence(rng, 60) for _ in range(4)]
    texts: list[str | None] = [None, "", "  \n\n ", "one", "One two!", "ALL", "!!! ???", "!!! ???", "x" * 20_000, "a a a a a a a " * 400]
    for i in range(40):
        lines = [sentence(rng, rng.randint(1, 12)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            lines[0:0] = shared[:2]
        if i % 4 == 0:
            lines += shared
        if i % 5 == 0:
            lines.append(f"{sentence(rng, 3)} {passage} {sentence(rng, 4)}")
        texts.append("\n".join(lines))
    for b in base:
        texts.append(b)
        words = b.split()
        for k in (7, 30):
            texts.append(" ".join([*words[:k], "changed", *words[k + 1 :]]))
        texts.append(b.upper() + ".")
    texts += texts[12:18]
    texts.append(sentence(rng, 3_000))
    rows = []
    for i, t in enumerate(texts):
        source = [None, "a", "b", "ä", "a", "a"][i % 6]
        rows.append((i, t, source, len(t or ""), "r", i, "id", 0.5, None))
    rows += [(None, texts[20], None, None, None, None, None, None, None)] * 2
    rows.append((None, "no id here", "a", 1, None, None, None, None, None))
    rows += [rows[25], rows[25]]
    rows.append((25, "another text of this id", "b", 3, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
