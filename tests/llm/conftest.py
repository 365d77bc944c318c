import os

import pytest

#: Workers import the library by name.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH")]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, kept boolean, n double, slot string, host string, gone int"


def sentence(seed: int, words: int) -> str:
    """Different words for different seeds, a rule instead of stored text."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973:x}{'.' if i % 9 == 8 else ''}" for i in range(words))


@pytest.fixture(scope="session")
def texts():
    """Texts with every oddity: NULL, empty, blank, one word, copies, near copies, shared passages, long runs, a very long text."""
    base = [sentence(k, 120) for k in range(12)]
    lines = ["\n".join(sentence(100 + 10 * k + j, 12) for j in range(8)) for k in range(4)]
    passage = sentence(777, 60)
    near = base[0].split()
    near[60] = "changed"
    out = [None, "", " \n\t ", "one", "two words", *base, base[1], base[1], " ".join(near), *lines,
           lines[0] + "\n" + sentence(55, 12), "\n".join(lines[1].split("\n")[2:6]) + "\n" + sentence(56, 30),
           sentence(60, 20) + " " + passage + " " + sentence(61, 20), sentence(62, 40) + "\n" + passage, passage,
           "the " * 200, "a b " * 150, "a b c a b c d " * 40, "x" * 5000, base[3].upper(), "ünï çödé " * 30, "# | * $ & " * 40,
           " ".join(sentence(900 + k, 400) for k in range(60))]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with clashing extra columns."""
    rows = [(k, t, "en", "s", None if t is None else len(t), 0.5, 1, True, 2.0, "slot", "host", 1) for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def messy(spark, texts):
    """The texts with repeated rows and NULL keys."""
    some = [(k, t) for k, t in texts if k % 3 == 0]
    rows = [(k, t, None, None, None, None, None, None, None, None, None, None) for k, t in [*texts, *some, *some, *[(None, t) for _, t in some], (None, None)]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
