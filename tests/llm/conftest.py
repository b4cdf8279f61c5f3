import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "tu") for b in ("ba", "de", "fi", "go", "ha", "ji")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, d double, tie string, score string, keep_id int, taken int"


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def edge_rows() -> list[tuple]:
    base, other = prose(1, 120), prose(2, 80)
    near = base[:60] + ["CHANGED"] + base[61:]
    less = base[:118]
    texts = [
        (1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(near)), (4, " ".join(less)), (5, " ".join(other)), (6, None), (7, ""), (8, "   \t\n "),
        (9, "one two three"), (10, "one two three"), (11, "ONE two three"), (None, "null id here"), (None, None), (12, "rep eat ed row"), (12, "rep eat ed row"),
        (13, "same id a"), (13, "same id b"), (14, "x" * 30000), (15, " ".join(prose(3, 20000))), (16, "Ünï ÇÖDÉ   　 ünï çödé 😀 \x1f\x0b end"),
        (17, "mail a.b@c.org ip 10.0.0.255 and 300.1.1.1 card 4111 1111 1111 1111 tel +1 (555) 010-9999"), (18, "ab" * 300), (19, "ab" * 300 + "z"),
        (20, "| a | b |\n!!! ***\n\n" * 30), (21, " ".join(other[:40] + prose(4, 60))), (-5, " ".join(near)), (22, "a  b   c \n\n d"), (23, "é"),
    ]
    return [(i, t, "en", None if k % 7 == 0 else f"s{k % 4}", None if t is None else len(t), k, "r", 0.5, "t", "s", 1, 2) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
