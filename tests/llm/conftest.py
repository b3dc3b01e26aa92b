import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["an", "er", "th", "ing", "on", "re", "é", "ß"]) for _ in range(rng.randint(1, 5))) for _ in range(400)]


@pytest.fixture(scope="session")
def rows(words):
    """Documents with copies, near copies, shared passages, ties, nulls, blanks and one long text."""
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    out = [(i, say(rng.randint(5, 120)), "en", f"src{i % 3}", 0) for i in range(60)]
    out += [(100 + i, out[3][1], "en", "src0", 0) for i in range(8)]
    out += [(200 + i, f"{say(20)}\n{passage}\t{say(15)}", "en", "src1", 0) for i in range(8)]
    out += [(300 + i, out[5][1] + f" {words[i]}", "en", None, 0) for i in range(5)]
    out += [(400, None, None, None, None), (401, "", "en", "src2", 0), (402, " \t\n", "en", "", 0), (403, say(4000), "en", "src0", 0)]
    out += [(404, "same same " * 40, "en", "src1", 0), (405, "a|b # $ < > % word", "en", "src2", 0), (3, out[3][1], "en", "src0", 0)]
    out += [(None, out[7][1], "en", "src1", 0), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The documents, with columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({"score": F.lit("x"), "n_words": F.lit(-1), "fp": F.lit("y"), "size": F.lit(1.5), "block": F.lit("z"), "shard": F.lit(9)})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
