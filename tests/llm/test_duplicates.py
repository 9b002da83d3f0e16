import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoframe.llm import line_dedup, near_dup, shared, suffix_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def changed(rnd, s, n):
    s = list(s)
    for _ in range(n):
        at = rnd.randrange(len(s) + 1)
        kind = rnd.randrange(3)
        if kind == 0:
            s.insert(at, rnd.choice("abé"))
        elif s:
            at = min(at, len(s) - 1)
            s[at : at + 1] = [rnd.choice("abé")] if kind == 1 else []
    return "".join(s)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance_and_probes(spark, most):
    rnd = random.Random(most)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 40))) for _ in range(60)]
    pairs = [(a, changed(rnd, a, rnd.randrange(0, most + 3))) for a in base for _ in range(5)] + [("", ""), ("a", ""), ("", "abcd"), ("ab" * 50, "ba" * 50)]
    a, b = F.col("a"), F.col("b")
    shorter = F.when(F.char_length(a) <= F.char_length(b), a).otherwise(b)
    longer = F.when(F.char_length(a) <= F.char_length(b), b).otherwise(a)
    met = F.coalesce(
        F.arrays_overlap(F.array(*line_dedup.index_keys(shorter, F.char_length(shorter), most)), F.array(*line_dedup.probe_keys(longer, F.char_length(longer), most))),
        F.lit(False),
    )
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within_edits(a, b, most).alias("near"), met.alias("met")).collect():
        near = edits(r.a, r.b) <= most
        assert r.near == near, (r.a, r.b)
        if near and min(len(r.a), len(r.b)) > most:
            assert r.met, (r.a, r.b)


def test_lines_have_few_keys_and_meet_all_the_same(spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefgh") if rnd.random() < 0.85 else " " for _ in range(n))
    base = [text(n) for n in (30, 60, 125, 240, 250, 479, 500, 700, 1000) for _ in range(12)] + ["x" * 300, "nospace" * 60]
    most = lambda n: max(k for least, k in line_dedup.EDITS if n >= least)
    pairs = [sorted((a, changed(rnd, a, rnd.randrange(most(len(a)) + 1))), key=len) for a in base for _ in range(4)]
    pairs = [(a, b) for a, b in pairs if len(a) >= 30 and edits(a, b) <= most(len(a))]
    classes = line_dedup._classes(30, line_dedup.EDITS)
    keys = lambda c: line_dedup.entry_array(F.col(c), F.char_length(c), classes)
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", keys("a").alias("x"), keys("b").alias("y")).collect()
    assert all({x.key for x in r.x if x.indexed} & {y.key for y in r.y} for r in rows)
    spaced = [len(r.x) for r in rows if len(r.a) >= 260 and " " in r.a]
    assert sum(spaced) / len(spaced) < 30  # 79 for a line when every shift was a key
    odd = [("ab cd" * 40, "ab cd" * 40 + "xyz"), ("é" * 100 + "u" * 40, "é" * 99 + "u" * 40), ("a" * 130, "b" * 130), (" " * 130, " " * 128)]
    near = [r.near for r in spark.createDataFrame(odd, "a string, b string").select(line_dedup.short_within(F.col("a"), F.col("b"), 2).alias("near")).collect()]
    assert near == [edits(a, b) <= 2 for a, b in odd]


def test_counts_leave_out_no_near_line(spark):
    rnd = random.Random(9)
    pairs = []
    for n in (30, 70, 150, 300):
        a = "".join(rnd.choice("etaoinsrhld xé") for _ in range(n))
        pairs += [(a, changed(rnd, a, k)) for k in (1, 2, 4, 8)] + [(a, "".join(rnd.choice("etaoinsrhld xé") for _ in range(n)))]
    of = lambda c: line_dedup.counts(F.col(c))
    rows = spark.createDataFrame([(a, b, k) for a, b in pairs for k in (1, 2, 4, 8)], "a string, b string, k int").select("a", "b", "k", line_dedup.counts_allow(of("a"), of("b"), F.col("k")).alias("may")).collect()
    assert all(r.may for r in rows if edits(r.a, r.b) <= r.k)
    assert sum(not r.may for r in rows) > 20


def brute_lines(rows, least, most):
    lines = [(d, i, x) for d, t in sorted(rows) for i, x in enumerate(t.split("\n")) if len(x) >= least]
    drop = collections.defaultdict(set)
    for n, (d, i, x) in enumerate(lines):
        if any(abs(len(x) - len(y)) <= most and edits(x, y) <= most for _, _, y in lines[:n]):
            drop[d].add(i)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop[d]) for d, t in rows}


@pytest.mark.parametrize("most", [1, 2])
@pytest.mark.parametrize("bound", [200_000, 0])
def test_line_dedup_equals_brute_force(spark, docs, monkeypatch, most, bound):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", bound)
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(8, 25))) + "." for _ in range(40)]
    rows = [(d, "\n".join(changed(rnd, rnd.choice(pool), rnd.choice([0, 0, 1, 2, 5])) for _ in range(6)) + "\nshort\n") for d in range(25)]
    rows.append((30, "\n".join([pool[0]] * 3)))
    want = brute_lines(rows, 10, most)
    for extra in [[], [(90, None), (91, ""), (92, "\n\n")]]:
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows + extra), 10, most).collect()}
        assert {d: t for d, t in got.items() if d < 90} == {d: t for d, t in want.items() if t.strip() or t == dict(rows)[d]}
        assert len(got) == len({d for d in got if d < 90}) + len(extra)


def test_line_dedup_of_odd_tables(spark, docs):
    line = "a line of some thirty characters or more"
    rows = [(None, line), (None, line), (1, line), (2, line + "\n" + "x" * 100_000), (2, line + "\n" + "x" * 100_000)]
    rows_, drops = line_dedup.repeated_lines(docs(rows))
    joined = rows_.join(drops, "row_id", "left").collect()
    # Rows of one id are copies of one document, a null id comes first.
    assert sorted((str(r.doc_id), tuple(r.places or ())) for r in joined) == [("1", (0,)), ("2", (0,)), ("2", (0,)), ("None", ()), ("None", ())]
    kept = line_dedup.dedup_lines(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.n_chars, len(r.text)) for r in kept.collect()) == [(len(line), len(line))] * 2 + [(100_000, 100_000)] * 2
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_line_edits_grow_with_length(spark, docs):
    rnd = random.Random(8)
    rows, lines = [], []
    for n in (30, 45, 59, 60, 61, 90, 119, 120, 123, 180, 239, 240, 247, 300, 479, 480, 700):
        base = "".join(rnd.choice("abcdefgh é") for _ in range(n - 1)) + "."
        lines += [base] + [changed(rnd, base, k) for k in (1, 2, 3, 4, 5, 8, 9, 12)]
    rows = [(d, "\n".join([line, "tiny", ""])) for d, line in enumerate(lines)]
    most = lambda n: max([k for least, k in ((30, 1), (60, 2), (120, 4), (240, 8)) if n >= least], default=-1)
    near = lambda x, y: abs(len(x) - len(y)) <= most(min(len(x), len(y))) and edits(x, y) <= most(min(len(x), len(y)))
    want = {d: "\n".join(([] if any(near(x, y) for y in lines[:d]) else [x]) + ([] if d else ["tiny"]) + [""]) for d, x in enumerate(lines)}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows), least_exact=1).collect()}
    assert got == {d: t for d, t in want.items() if t.strip()}


def test_near_copies_are_compared_but_not_kept_as_pairs(spark, docs, monkeypatch):
    rnd = random.Random(11)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(59)) + "."
    lines = [base, *[changed(rnd, base, rnd.randrange(8)) for _ in range(99)]]
    kept, real = {}, line_dedup.written

    def written(df, name):
        out = real(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", written)
    monkeypatch.setattr(line_dedup, "CELL_LINES", 20, raising=False)
    rows = [(d, line) for d, line in enumerate(lines)]
    want = brute_lines(rows, 10, 4)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows), 10, 4).collect()}
    assert got == {d: t for d, t in want.items() if t}
    # 100 lines give up to 4,950 pairs; a line has 17 keys at most, whatever the number of its near copies
    assert max(kept.values()) <= 17 * len(lines), kept


def test_bounds_from_counts_hold(spark):
    rnd = random.Random(12)
    pairs = []
    for n in (30, 64, 131, 250):
        a = "".join(rnd.choice("abceiostré. ") for _ in range(n))
        pairs += [(a, changed(rnd, a, k), k) for k in (1, 2, 4, 8) for _ in range(5)]
    half = F.floor(F.least(F.char_length("a"), F.char_length("b")) / 2).cast("int")
    got = spark.createDataFrame(pairs, "a string, b string, k int").select(
        line_dedup.marks_allow(line_dedup.marks(F.col("a")), line_dedup.marks(F.col("b")), F.col("k")),
        line_dedup.ends_allow(line_dedup.ends(F.col("a"), half), line_dedup.ends(F.col("b"), half), F.col("k")),
    )
    assert all(r[0] and r[1] for r in got.collect())
    other = spark.createDataFrame([("a" * 9, "e" * 9)], "a string, b string").select(line_dedup.marks_allow(line_dedup.marks(F.col("a")), line_dedup.marks(F.col("b")), F.lit(2)))
    assert not other.first()[0]


def shingles(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_classes(rows):
    bags = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                parent[find(i)] = find(j)
    return {frozenset(i for i in range(len(rows)) if find(i) == r) for r in {find(i) for i in range(len(rows))}}


def test_near_duplicates_equal_brute_force(spark, docs):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for base in range(12):
        words = [rnd.choice(vocab) for _ in range(150)]
        for _ in range(rnd.choice([1, 2, 6, 20])):
            mine = list(words)
            for _ in range(rnd.choice([0, 1, 3, 5])):
                mine[rnd.randrange(150)] = rnd.choice(vocab)
            words = mine if rnd.random() < 0.3 else words  # chains of small steps
            rows.append((len(rows), " ".join(mine)))
    rows += [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One, two!"), (905, "spam " * 500), (906, "spam " * 480), (907, "spam " * 100)]
    got = near_dup.near_duplicates(docs(rows)).collect()
    at = {d: i for i, (d, _) in enumerate(rows)}
    classes = collections.defaultdict(set)
    for r in got:
        classes[r.class_id].add(at[r.doc_id])
        assert r.class_id <= r.doc_id
    assert {frozenset(c) for c in classes.values()} == brute_classes(rows)


def test_near_duplicates_count_before_they_fetch(spark, docs, monkeypatch):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    body, passage = [word() for _ in range(120)], [word() for _ in range(12)]
    rows = []
    for d in range(60):  # copies with edits of their own, half of them with one passage the others lack
        mine = list(body)
        for _ in range(4 if d % 2 else 3):
            mine[rnd.randrange(120)] = word()
        rows.append((d, " ".join(mine[:60] + (passage if d % 2 else []) + mine[60:])))
    sizes = {}

    def counted(df, name):
        out = shared.written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(near_dup, "written", counted)
    got = near_dup.near_duplicates(docs(rows)).collect()
    classes = collections.defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
    assert {frozenset(c) for c in classes.values()} == brute_classes(rows)
    assert sizes["near-rest"] < 60


def test_near_duplicates_of_odd_tables(spark, docs):
    text = "the very same words in this very text here"
    rows = [(None, text), (5, text), (5, text), (4, "x " * 60_000)]
    got = sorted((str(r.doc_id), str(r.class_id), r.row_id == r.class_row) for r in near_dup.near_duplicates(docs(rows)).collect())
    assert got == [("4", "4", True), ("5", "None", False), ("5", "None", False), ("None", "None", True)]
    kept = near_dup.dedup_near(docs(rows))
    assert kept.columns == docs(rows).columns and kept.count() == 2
    assert near_dup.near_duplicates(docs([])).count() == 0


def test_rows_keep_their_numbers_when_splits_change(spark, docs, monkeypatch, tmp_path):
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    rows = [(d, " ".join(word(i) for i in range(60 * (d // 2), 60 * (d // 2) + 60)) + ("" if d % 2 else " more")) for d in range(24)]
    docs(rows).repartition(8, "doc_id").write.parquet(f"{tmp_path}/d")
    sizes = iter(["1k", "128m", "6k", "12k"] * 20)

    def resized(df, name):
        out = shared.written(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return out

    monkeypatch.setattr(near_dup, "written", resized)
    try:
        got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.read.parquet(f"{tmp_path}/d")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {d: d - d % 2 for d in range(24)}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    items = shared.mix(np.arange(1, 201, dtype=np.uint64))
    a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sigs = [near_dup.signatures(np.zeros((x > 0).sum(), np.int64), items[x > 0], x[x > 0], 1, 4096)[0] for x in (a, b)]
    assert abs((sigs[0] == sigs[1]).mean() - true) < 0.04


def brute_bytes(rows, length):
    seen, out = set(), []
    for d, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            w = x[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("bound", [200_000, 100])
@pytest.mark.parametrize("partitions", ["3", "40"])
def test_suffix_dedup_equals_brute_force(spark, docs, monkeypatch, bound, partitions):
    monkeypatch.setattr(suffix_dedup, "GROUP_STRINGS", bound)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(7))
    passages = ["".join(word() for _ in range(n)) for n in (14, 16, 40)]
    rows = [(d, "".join(rnd.choice([word() * 3, word() * 5, rnd.choice(passages)]) for _ in range(20))) for d in range(40)]
    rows += [(50, None), (51, ""), (52, "ab" * 400), (53, "a" * 300), (54, "x" + "ab" * 90), (55, rows[3][1]), (56, rows[3][1]), (57, rows[3][1][5:])]
    rows += [(d, passages[2] * 2) for d in range(60, 90)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffix_dedup.repeated_bytes(docs(rows)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == brute_bytes(rows, 100)


def test_suffix_dedup_of_odd_tables(spark, docs):
    long = "".join(chr(97 + i % 7) + str(i) for i in range(30_000))
    got = suffix_dedup.repeated_bytes(docs([(1, long), (1, long), (None, long)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", len(long)), ("1", len(long)), ("None", 0)]
    assert suffix_dedup.repeated_bytes(docs([])).count() == 0


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (500, 20)).astype(np.uint8)
    order, group = suffix_dedup.multikey_quicksort(suffix_dedup._tokens(rows))
    done = [bytes(r) for r in rows[order]]
    assert done == sorted(map(bytes, rows))
    assert [a == b for a, b in zip(done, done[1:], strict=False)] == (np.diff(group) == 0).tolist()


