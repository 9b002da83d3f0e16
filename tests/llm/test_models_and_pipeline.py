import random
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isoframe.llm import packing, toxicity
from .test_duplicates import brute_classes, brute_lines
from .test_search_and_text import brute_hits

SF = "/root/testdata/sf0.001"


def brute_segments(s):
    """Best segment first, then both sides of it: the definition of all maximal segments."""
    if not len(s) or max(s) <= 0:
        return []
    total = np.concatenate([[0.0], np.cumsum(s)])
    score, a, b = max(((total[j] - total[i], i - j, -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda x: x)
    a, b = -b, -b - a
    return [*brute_segments(s[:a]), (a, b), *[(i + b, j + b) for i, j in brute_segments(s[b:])]]


def test_maximal_segments():
    rnd = random.Random(0)
    for _ in range(300):
        s = np.array([rnd.choice([-3.0, -1.0, 2.0, 1.5, -0.7]) + rnd.random() * 1e-3 for _ in range(rnd.randrange(0, 14))])
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute_segments(s)


def corpus(rnd, n):
    words = ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    rows, labels = [], []
    for d in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 80))]
        if d % 5 == 0:
            for _ in range(2):
                text.insert(rnd.randrange(len(text)), rnd.choice(["vilewordone", "vilewordtwo", "Vilewordthree"]))
        rows.append((d, " ".join(text)))
        labels.append((d, int(d % 5 == 0)))
    return rows, labels


def test_toxicity_on_held_out_labels(spark, docs):
    rows, labels = corpus(random.Random(1), 600)
    rows += [(1000, None), (1001, ""), (None, "vilewordone vilewordtwo"), (0, rows[0][1])]
    table = spark.createDataFrame([*labels, (5, None), (None, 1), (0, 0)], "doc_id long, toxic int").withColumn("text", F.lit("not this"))
    train = toxicity.training_labels(table)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in train.where("doc_id is not null").collect())
    model = toxicity.learn(docs(rows), train)
    got = toxicity.score_documents(docs(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held]) > 0.97
    hit = next(r for r in got if r.doc_id is None)
    assert [(p.first, p.end) for p in hit.passages] == [(0, 2)]
    assert {r.doc_id for r in got if r.score >= 0.7}.isdisjoint({1000, 1001})
    kept = toxicity.reject(docs(rows), table)
    assert kept.columns == docs(rows).columns and {1000, 1001} <= {r.doc_id for r in kept.collect()}


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_documents(docs([(1, "a b"), (2, None)]), toxicity.learn(docs([(1, "a b"), (2, None)]), labels)).collect()
    assert all(r.score < 1e-3 for r in got)
    assert toxicity.reject(docs([]), labels).count() == 0


def test_packing(spark):
    rnd = random.Random(2)
    items = [(i, rnd.choice([1, 5, 100, 500, 513, 1024, 4096, 4097, 9000, rnd.randrange(1, 5000)])) for i in range(1500)]
    items += [(3, 700)] * 400 + [(9001, 0), (9002, None), (None, 10)]
    table = spark.createDataFrame(items, "doc_id long, n_tokens long").withColumn("shard", F.lit(1))
    got = packing.best_fit(table, shard_pieces=500).collect()
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= rows[0].bin_length and {r.bin_length for r in rows} == {min(c for c in packing.LENGTHS if c >= at)}
    whole = sum(n or 0 for _, n in items)
    assert sum(r.n_tokens for r in got) == whole
    assert whole / sum(rows[0].bin_length for rows in bins.values()) > 0.95
    assert sorted(str(r.doc_id) for r in got if r.bin_id is None) == ["9001", "9002"]
    assert sum(r.doc_id is None for r in got) == 1
    assert packing.best_fit(table.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, final = packing.pack(np.array([60, 50, 40, 30]), (64, 100), 0)
    assert sorted(zip(bins.tolist(), offsets.tolist(), final.tolist(), strict=True)) == [(0, 0, 100), (0, 60, 100), (1, 0, 100), (1, 50, 100)]


def test_stages_against_brute_force(spark, docs, tmp_path):
    """Stages two to four on a table of their own, row by row."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    line = lambda: " ".join(word() for _ in range(12))
    pool = [line() for _ in range(5)]
    rows = [(d, "\n".join([line() for _ in range(6)] + [rnd.choice(pool)])) for d in range(40)]
    rows += [(50 + i, "\n".join(x.replace("a", "b", 1) for x in rows[i][1].split("\n"))) for i in range(6)]
    items = [(i, rows[30 + i][1].split("\n")[0]) for i in range(3)] + [(9, line())]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]

    def store(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    lines = store(stages["line_dedup"](spark, store(docs(rows), "a"), str(tmp_path)), "b")
    want = {d: t for d, t in brute_lines(rows, 30, 1).items() if t.strip()}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    near = store(stages["near_dedup"](spark, lines, str(tmp_path)), "c")
    left = sorted(want.items())
    kept = {left[min(c)][0] for c in brute_classes(left)}
    assert {r.doc_id for r in near.collect()} == kept
    clean = store(stages["decontamination"](spark, near, str(tmp_path)), "d")
    good = {d for d in kept if not brute_hits(want[d], items)[1]}
    assert {r.doc_id for r in clean.collect()} == good and lines.columns == near.columns == clean.columns == docs(rows).columns
    packed = stages["packing"](spark, clean, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == good


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pipeline_runs(spark):
    packed = corpus_pipeline.run(spark, SF).collect()
    assert packed and all(r.bin_offset + r.n_tokens <= r.bin_length for r in packed if r.bin_id is not None)


def test_stored_rows_do_not_depend_on_splits(spark, docs, tmp_path):
    from isoframe.llm import shared

    path = str(tmp_path / "docs")
    docs([(i % 7, f"text {i}") for i in range(5000)]).repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    seen = []
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = shared.stored_rows(spark.read.parquet(path), "t", "row_id_")
            seen.append({r.row_id_: (r.doc_id, r.text) for r in rows.collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(seen[0]) == 5000 and seen[0] == seen[1]
    made = shared.stored_rows(docs([(1, "a"), (2, "b")]), "t", "n")  # no file: written once
    assert made.select("n").distinct().count() == 2 and made.inputFiles()
    assert shared.stored_rows(spark.read.parquet(path).limit(0), "t", "n").count() == 0


def test_stages_keep_columns_of_their_own_names(spark, docs, tmp_path):
    from isoframe.llm import decontaminate, line_dedup, near_dup, private

    rows = [(i, f"{w} stand here with words of their own") for i, w in enumerate(("seven white horses", "the old ships of Rhodes", "no more than two"))] + [(4, None), (5, ""), (None, "no id")]
    table = docs(rows).withColumns({c: F.lit("mine") for c in ("__row", "__places", "__clean")})
    item = spark.createDataFrame([("q", "an item that no document has at all in it")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for made in (line_dedup.dedup_lines(table), near_dup.dedup_near(table), decontaminate.clean(table, item), private.redact(table), toxicity.reject(table, labels, 2.0)):
        assert sorted(made.columns) == sorted(table.columns)
        got = made.collect()
        assert len(got) == len(rows) and {r["__row"] for r in got} == {r["__clean"] for r in got} == {"mine"}


def test_token_counts_hold_little_at_once(spark):
    class Asked(Exception):
        pass

    class Texts:
        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            raise Asked(function)

    with pytest.raises(Asked) as asked:
        toxicity.token_counts(Texts())
    text = " ".join(f"word{i % 5000}" for i in range(2500))
    batch = pa.RecordBatch.from_pydict({"text": [text] * 200, "toxic": [i % 2 for i in range(200)]})
    tracemalloc.start()
    try:
        counted = sum(pc.sum(b.column(1)).as_py() for b in asked.value.args[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counted == 200 * 2500
    assert peak < 40 << 20  # of 4 MB of text; numpy's arrays are traced
