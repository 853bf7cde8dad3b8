import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """``n`` words, each of which depends on its place and the seed."""
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] + str((seed * i) % 97) for i in range(n))


def hard_rows() -> list[tuple]:
    """doc_id, text: copies, near copies, nulls, empty, blank, very long, odd characters, repeated rows."""
    base = prose(3, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(i, prose(100 + i, 40 + 7 * i)) for i in range(12)]
    rows += [(20, base), (21, base), (22, near), (23, base.upper()), (24, base + " tail")]
    rows += [(30, None), (31, ""), (32, " \t\n "), (33, "one"), (34, "one"), (35, "one two three")]
    rows += [(40, prose(5, 30_000)), (41, "same line\n" * 50), (42, "naïve  café   <|endoftext|> \r\n x  \x00y")]
    rows += [(50, prose(50, 80)), (50, prose(50, 80)), (None, prose(51, 60)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows with extra columns whose names operators use themselves."""
    rows = [(d, t, "src", 1, "x", 7, "y") for d, t in hard_rows()]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, component int, node string, shard int, token string"
    ).repartition(5)


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.where("false")
