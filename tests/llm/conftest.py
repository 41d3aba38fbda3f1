import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and licence mit license apache general public Über é日本 don't x1 # | a,b foo. BAR bar".split()


def texts(seed=4, n=60):
    """Nulls, blanks, odd white space, copies, near copies, shared passages, one long text."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(WORDS) + str(rnd.randint(0, 60))
    base = [" ".join(word() for _ in range(rnd.randint(1, 90))) for _ in range(n)]
    passage = " ".join(word() for _ in range(30))
    out = [None, "", "  \n\t ", "one", "One  two\x0bthree", *base, *base[:8], *base[:3]]
    out += [f"{a}\n{passage}\x85 {b}" for a, b in zip(base[10:30], base[30:50], strict=True)]
    for t in base[:12]:
        ws = t.split()
        ws[len(ws) // 2] = "changed"
        out.append(" ".join(ws))
    out.append(" ".join(word() for _ in range(20_000)) + " " + passage)
    return out


@pytest.fixture(scope="session")
def rows():
    t = texts()
    ids = [i * 3 + 1 for i in range(len(t))]
    return [*zip(ids, t, strict=True), (ids[6], t[6]), (ids[6], t[6]), (None, t[7]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows in the columns of documents, beside extra columns whose names operators might use."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
                    *[F.lit(7).alias(c) for c in ("_id", "_text", "_key", "_hash", "_block", "_text_hash", "_quality", "_pii", "kept", "n", "c", "a.b", "_digest", "host", "_gone", "_found")]).repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
