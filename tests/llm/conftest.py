import random

import pytest

WORDS = "the of and alpha Beta gamma délta epsilon zeta eta théta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
#: Columns whose names the operators use inside.
CLASHES = "id long, s1 int, s2 int, key string, spans string, node string, n long, kept boolean, words string, entry long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "x" + str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, ties, nulls, empty and long texts."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (400, 300, 250, 120, 90, 60)]
    passage = prose(rng, 75)
    out = [*base, base[0], base[0], base[1] + " tail end", passage, prose(rng, 30) + " " + passage + " " + prose(rng, 40), passage + " " + prose(rng, 9)]
    edited = base[2].split()
    for k in range(6):
        copy = list(edited)
        copy[rng.randrange(len(copy))] = "changed"
        copy[rng.randrange(len(copy))] = f"edit{k}"
        out.append(" ".join(copy))
    out += [None, "", " \n\t ", "one", "One", "two words", "a" * 900, "ab" * 400, "日本 " * 300, "x\u00a0y z", prose(rng, 9000), ("loop " * 7 + "end ") * 30]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns of clashing names."""
    names = CLASHES.count(",") + 1
    return spark.createDataFrame([(i, t, *[None] * names) for i, t in texts], "doc_id long, text string, " + CLASHES).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
