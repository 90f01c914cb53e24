import random

import pytest
from pyspark.sql import types as T

WORDS = [a + b for a in ("ta", "ko", "mi", "re", "su", "na") for b in ("lo", "pe", "ri", "du", "ga")]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("k", T.StringType()), T.StructField("path", T.IntegerType())])


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def hard_texts():
    """Nulls, empties, blanks, repeats, copies, near copies, shared passages, long and unbroken texts, other scripts."""
    r = random.Random(5)
    long, passage = prose(r, 4000), prose(r, 60)
    base = prose(r, 200)
    near = base.split(" ")
    near[20] = "changed"
    out = [None, "", "   \n\t ", "one", "two words", base, base, " ".join(near), "x" * 3000, "é中文あ " * 40, long]
    out += [f"{prose(r, 30)} {passage} {prose(r, 30)}" for _ in range(6)]
    out += ["a b " * 60, "\n".join(["Same line here."] * 30 + [prose(r, 20)]), long[: len(long) // 2] + prose(r, 100), "<|endoftext|> mail j.doe@site.org or +1 (386) 555-3733 <|endoftext|>", "Übung ß \x00\x1c  end"]
    out += [prose(r, r.randint(5, 120)) for _ in range(30)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """Extra columns clash with names that operators use inside; one source is null."""
    rows = [(i * 3, t, "en", None if i % 9 == 0 else f"src{i % 3 if i % 2 else 0}", None if t is None else len(t), "i", "k", 1) for i, t in enumerate(hard_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def doubled(spark):
    """Repeated rows, rows of equal id and different text, rows without id."""
    rows = [(1, "p q r s t u v " * 12), (1, "p q r s t u v " * 12), (1, "other words here " * 9), (None, "p q r s t u v " * 12), (None, None), (4, "alone at last")]
    return spark.createDataFrame([(i, t, "en", "s", None, None, None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 200)] + [(3, None, None)], "doc_id long, quality int, toxic int")
