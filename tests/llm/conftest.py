import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

ODD_TEXTS = [
    None, "", " ", "\n", "\n\n", "one", "One", "one two", "one  two\tthree\r\n four ", "A line that repeats itself here\nshort\nA line that repeats itself here ", "  a LINE that repeats itself HERE\nother words follow in this one",
    "mail bob.34@mail7.example.com or +1 (826) 555-4081 190.137.223.204 now", "card 4845168114407329 4845168114407329 end", "ip 1.2.3.4 and 999.1.1.1, a@b, a@b.c@d.e x@-.-", "+49 30 1234567 éè 中文 \U0001f600 é 'tis don't <|endoftext|> 12'34", "tab\tand\x0bvertical\x0cfeed\x1cfile nbsp em",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "x" * 5000, "word " * 3000, "ßä " * 400 + "Straße",
]


def make_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ed", "nd", "ha", "é", "ü"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))).capitalize() + "."
    shared = [line() for _ in range(6)]
    out = []
    for _ in range(n):
        text = "\n".join(rng.choice(shared) if rng.random() < 0.2 else line() for _ in range(rng.randint(1, 12)))
        out.append(text)
        if rng.random() < 0.15:
            out.append(text)
        if rng.random() < 0.15:
            w = text.split(" ")
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out


@pytest.fixture(scope="session")
def texts():
    return ODD_TEXTS + make_texts(150)


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids are unique; columns with names that operators use for their own."""
    rng = random.Random(1)
    rows = [(7 * k, t, rng.choice(["en", None]), rng.choice(["b", "a", "z", None, "b", "b"]), len(t or ""), k, "x", True) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines int, id string, taken boolean").repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated ids, repeated rows."""
    rows = [(None, "null id one two three four five six"), (None, "null id one two three four five six"), (None, None), (1, "same id first text of the two rows"), (1, "same id second text of the two rows"), (2, "row that is there twice in this table"), (2, "row that is there twice in this table"), (3, ""), (4, None)]
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def ordered(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: r[0])
