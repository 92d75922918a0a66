import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, a shared passage, personal data, odd white space, empty and null ones."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(30)
    out = [None, "", "   \n\t ", "one", "two words", "A b c d", "É à ÜÑ", "x" * 5000]
    base = [prose(rng.randint(40, 120)) for _ in range(40)]
    out += base
    out += [base[0]] * 6 + [base[1].upper()]
    for t in base[2:12]:
        w = t.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    chain = prose(100).split()
    for i in range(8):
        chain = chain[2:] + prose(2).split()
        out.append(" ".join(chain))
    out += [f"{prose(20)} {passage} {prose(30)}" for _ in range(12)]
    out += [f"mail {word()}.{i}@mail{i}.example.com or +1 (98{i % 10}) 555-24{i:02d}, host 10.0.{i}.7 card 4111 1111 1111 1111" for i in range(30)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    from pyspark.sql import functions as F

    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 5}", len(t or ""), f"x{i}") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "a text without an id of its own here", "en", "s1", 3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").withColumn("shard", F.lit("own"))


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
