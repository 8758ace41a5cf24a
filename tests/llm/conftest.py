import random

import pytest

WORDS = "river stone apple cloud green train paper light house water field music north table glass winter summer bread".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) rows with nulls, empty and long texts, copies, near copies and repeated rows."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = prose(2, 60)
    rows = [(i, prose(100 + i, 40 + 7 * i)) for i in range(20)]
    rows += [
        (20, base), (21, base), (22, " ".join(near)), (23, None), (24, ""), (25, "word"), (26, "two words"), (27, "!!! ..."),
        (28, "!!! ..."), (29, prose(3, 30) + " " + shared + " " + prose(4, 30)), (30, prose(5, 10) + " " + shared),
        (31, "ab " * 400), (32, "é" * 300), (33, prose(6, 6000)), (34, "word"), (35, None), (36, base.upper()),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with columns whose names the operators use themselves."""
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", len(t or ""), "x", 1, "y") for i, t in texts]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, shard string, size int, spans string",
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
