import hashlib
from collections import defaultdict

import pytest

from isoframe.llm.exact_dedup import exact_groups


def brute(rows, normalise=lambda t: t):
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[normalise(t or "")].append((i is not None, i if i is not None else 0, at, i))
    out = []
    for text, members in groups.items():
        largest = max(members)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], largest[3], len(members), m is largest, digest) for m in members]
    return sorted(out, key=repr)


def mine(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


LONG = "héllo wörld " * 3000
ROWS = [
    (1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "a"), (None, "only nulls"), (None, "only nulls"),
    (7, LONG), (8, LONG), (9, LONG + "x"), (10, LONG + "y"), (11, LONG[:-1] + "z"), (12, "x" * 63), (13, "x" * 64), (14, "x" * 65),
    (15, "x" * 64), (16, "x" * 64 + "a"), (17, "x" * 64 + "b"), (18, "a\x00"), (19, "a\x00"), (20, "a\x01"), (21, "A"), (5, "b"), (5, "b"),
] + [(100 + i, "one text that most rows have, longer than the first digit of sixty-four bytes") for i in range(60)]


def test_equals_brute_force(spark, docs):
    assert mine(exact_groups(docs(ROWS))) == brute(ROWS)


@pytest.mark.parametrize("first, growth", [(1, 2), (7, 3)])
def test_digits_do_not_matter(spark, docs, first, growth):
    rows = ROWS[:6] + ROWS[11:]
    assert mine(exact_groups(docs(rows), first=first, growth=growth)) == brute(rows)


def test_normalised_texts(spark, docs):
    from pyspark.sql import functions as F

    assert mine(exact_groups(docs(ROWS), normalise=F.lower)) == brute(ROWS, str.lower)


def test_empty_table(spark, docs):
    assert exact_groups(docs([])).collect() == []


def test_other_splits_of_the_files(spark, docs, tmp_path):
    docs(ROWS * 3).repartition(5).write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in ("1k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(mine(exact_groups(spark.read.parquet(str(tmp_path / "d")))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == brute(ROWS * 3)
