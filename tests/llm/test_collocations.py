import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from isoframe.llm.collocations import RANGE_BYTES, SHARD_BITS, SHORT_BITS, _frequent, collocations, phrase_counts

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def grams(rows, longest):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    return counts, totals


def brute(rows, support, longest, top, percent=50):
    counts, totals = grams(rows, longest)
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        found = []
        for p, a in frequent.items():
            within = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= percent * a for b in within):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mine(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus():
    draw = random.Random(11)
    words = ["The", "the", "cat", "sat", "Été", "été", "日本", "a-b", "x y", " ", "mat", "on"]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "! ", " ; "]
    text = lambda n: "".join(draw.choice(words) + draw.choices(ends, [9, 2, 2, 1, 1, 1, 1, 1])[0] for _ in range(n))
    rows = [(text(draw.randrange(120)), draw.choice(["en", "fr", None, "und", ""])) for _ in range(80)]
    return rows + [(None, "en"), ("", None), (" \t", "xx"), (". . .", "en"), ("new york city " * 40, "en"), ("New York City " * 40, "fr")] + [("same text in many rows", "en")] * 60


@pytest.fixture
def table(spark):
    def make(rows):
        schema = "text string, lang string, size int, phrase string, f long, w string, cell int"
        return spark.createDataFrame([(*r, 0, "p", 0, "w", 0) for r in rows], schema).repartition(3)

    return make


@pytest.mark.parametrize("support, longest, shards", [(10, 3, 3), (4, 4, 2), (1, 2, 1)])
def test_equals_brute_force(table, support, longest, shards):
    rows = corpus()
    found = mine(collocations(table(rows), support=support, longest=longest, shards=shards))
    assert found and found == brute(rows, support, longest, 2000)


def test_top_and_ties(table):
    rows = corpus()
    assert mine(collocations(table(rows), support=3, top=4)) == brute(rows, 3, 3, 4)


def test_long_text_in_several_runs(table):
    draw = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", ", "]) for _ in range(900_000))
    counts, totals = grams([(text, "en")], 3)
    found = {(r["size"], r["phrase"]): r["f"] for r in phrase_counts(table([(text, "en")]), support=20).collect()}
    wanted = {(len(p), " ".join(p)): a for p, a in counts["en"].items() if a >= 20}
    assert len(text) > 5_000_000 and found == wanted | {(0, ""): totals["en"]}


def test_empty_table(table):
    assert collocations(table([])).collect() == []


def test_a_range_is_counted_in_little_memory():
    rng = np.random.default_rng(3)
    keys = [np.sort(rng.integers(0, 1 << 20, 200_000, dtype=np.uint32)) for _ in range(5)]
    counts = [rng.integers(1, 3, len(k)).astype(np.uint16) for k in keys]
    table = pa.table({"part": [7] * 5, "keys": [k.tobytes() for k in keys], "counts": [c.tobytes() for c in counts]})
    tracemalloc.start()
    got = _frequent(4)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = np.zeros(1 << 20, np.int64)
    for k, c in zip(keys, counts, strict=True):
        np.add.at(total, k, c)
    want = np.unique(np.flatnonzero(total >= 4).astype(np.uint64) >> np.uint64(SHARD_BITS)) | np.uint64(7 << SHORT_BITS)
    assert np.array_equal(np.frombuffer(got["hashes"][0].as_buffer(), np.uint64), want) and got["n"][0].as_py() == len(want)
    assert peak < 28 * 1_000_000  # bytes for a million hashes
    assert RANGE_BYTES <= 4_000_000
