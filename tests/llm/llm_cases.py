import os
import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_texts(spark, sf):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau "
         "upsilon phi chi psi omega café über ñandú").split()


def prose(n, seed):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(["", "", "", str(pick.randrange(50)), ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null, empty, short and very long texts, copies, near copies,
    repeated rows, and extra columns with clashing names."""
    long = prose(40_000, 1)
    base = prose(300, 2)
    near = base.split()
    near[150] = "changed"
    rows = [(1, base), (2, base.upper()), (3, " ".join(near)), (4, base.replace(" ", "\n")), (5, None), (6, ""), (7, "  \t\n"),
            (8, "one two"), (9, "One two"), (10, long), (11, long[: len(long) // 2] + " cut here"), (12, "a" * 5000),
            (12, "a" * 5000), (13, prose(120, 3)), (13, prose(120, 4)), (None, base), (None, None), (14, "x\ny\nz\nx\ny\nz\nw"),
            (15, "\n\n\n\n\n"), (16, "mail a.b@c-d.example.org_x@y.z and +1 (555) 010-9999, 4111 1111 1111 1111, 10.0.0.300 1.2.3.4"),
            (17, "1.2.3.4.5.6.7.8 999.1.1.1 12345678901234567890 @@ +12 +123456789 0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"score": F.lit(1), "h": F.lit("x"), "n": F.lit(None).cast("int"), "token": F.lit("y"), "id": F.lit(0)})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
