import re

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, row_id string, kept string, size string, spans string, component_id int, score string, bucket string, batch string, key string, taken string"
SPACE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéfgh") for _ in range(r.randint(2, 9))) for _ in range(n))


def rows():
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["other"] + words[61:])
    far = " ".join(words[:90] + prose(2, 40).split(" "))
    text = [
        (1, base), (2, base.upper() if False else base), (3, near), (4, far), (5, prose(3, 3)), (6, prose(3, 3)), (7, ""), (8, None), (9, " \n\t "),
        (10, prose(4, 9000)), (11, base + "  "), (12, base.replace(" ", "\n")), (13, "x " * 400), (13, "x " * 400), (14, "one"), (None, prose(5, 50)),
        (15, prose(6, 200) + " " + base[:300]), (16, "mail a.b@c.de call +1 (555) 555-0199 or 10.0.0.1, card 4111 1111 1111 1111."), (17, near), (18, "".join("0123456789" * 500)),
    ]
    return [(i, t, "en", None if i is None else f"s{i % 3}", len(t or ""), "r", "k", "z", "s", 5, "x", "b", "q", "key", "t") for i, t in text]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, and columns whose names the operators use."""
    return spark.createDataFrame(rows(), DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1] or "") for r in rows()]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)
