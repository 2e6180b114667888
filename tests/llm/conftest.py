import random

import pytest

@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): near copies, exact copies, repeated rows, nulls, odd texts."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = []
    for base in range(12):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = own[:]
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            cut = sorted(rng.sample(range(len(copy)), 3))
            texts.append("\n".join(" ".join(copy[a:b]) for a, b in zip([0, *cut], [*cut, len(copy)])))
    texts += [texts[0], texts[0], "", " \n\t ", "one", "one two", "One  TWO", None, None, "é ü 漢字 " * 40, "x " * 3000 + "y"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[1], None, None, 3), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    frame = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    # names that operators use themselves
    return frame.selectExpr("*", "1 as row", "2 as t", "'x' as words", "3 as id", "4 as size", "5 as key", "6 as gone", "7 as kept").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
