"""Near duplicates by BagMinHash signatures, bands and verified multiset overlap.

A text is the multiset of its shingles of k words. Each (shingle, level) has Poisson processes of its own,
level l standing for the copies 2^l .. 2^(l+1) - 1 of the shingle, with points that carry a copy and a
register. A register keeps the first point whose copy the text holds, so two texts agree in a register
with the probability of their weighted Jaccard similarity. Points are drawn in rounds and a process stops
once its time passes the largest register.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, hashed_words, keyed, mix, shingle_hashes, text_slices, written

WORDS = 5
SIMILARITY = 0.8
#: Bands of rows: a pair of similarity 0.8 meets in none of 24 bands of 5 with probability 7e-5.
BANDS = 24
ROWS = 5
#: Members of one leader compared in one task, on average.
FAN = 500



def _uniform(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from mixed 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bags(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text, shingle, count), sorted by both."""
    shingles, owner = shingle_hashes(words, first, k)
    order = np.lexsort((shingles, owner))
    s, o = shingles[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], s[at], np.diff(np.append(at, len(s)))


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """BagMinHash registers of each text; an empty text has infinite ones."""
    sig = np.full((texts, registers), np.inf)
    flat = sig.reshape(-1)
    levels = np.floor(np.log2(count)).astype(np.int64) + 1 if len(count) else np.zeros(0, np.int64)
    src = np.repeat(np.arange(len(count)), levels)
    level = np.arange(len(src)) - np.repeat(np.cumsum(levels) - levels, levels)
    own, held = owner[src], count[src]
    seed = mix(shingle[src] + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    width = np.left_shift(1, level)
    time = np.zeros(len(src))
    step = 0
    while len(src):
        r = mix(seed + np.uint64((0x9E3779B97F4A7C15 * (2 * step + 1)) & (2**64 - 1)))
        time = time - np.log(_uniform(r)) / width
        r = mix(r ^ np.uint64(0xA0761D6478BD642F))
        copy = width + (r >> np.uint64(32)).astype(np.int64) % width  # copies are numbered from 1 up to the count
        register = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        ok = copy <= held
        np.minimum.at(flat, own[ok] * registers + register[ok], time[ok])
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))  # rows of a text lie together
        on = time < np.repeat(sig[own[edge]].max(axis=1), np.diff(np.append(edge, len(own))))
        src, own, held, seed, width, time = src[on], own[on], held[on], seed[on], width[on], time[on]
        step += 1
    return sig


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    raw = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.full((len(sig), bands), 0, np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(3) + raw[:, :, i])
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64)[None, :])


def _scan(rows: DataFrame, k: int, bands: int, band_rows: int) -> DataFrame:
    """(row_id, doc_id, c1, c2, n, bands) from (row_id, doc_id, text): c1 and c2 hash the whole multiset, n is its size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2), 1 << 20):
                words, first, _, _ = hashed_words(data, offsets)
                owner, shingle, count = bags(words, first, k)
                m = b - a
                part = mix(shingle + count.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                c = []
                for salt in (1, 2):
                    x = mix(part + np.uint64(salt))
                    total = np.concatenate([[np.uint64(0)], np.cumsum(x)])
                    edges = np.searchsorted(owner, np.arange(m + 1))
                    c.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
                n = np.bincount(owner, count, m).astype(np.int64)
                keys = _bands(signatures(owner, shingle, count, m, bands * band_rows), bands, band_rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), batch.column(1).slice(a, m), pa.array(c[0]), pa.array(c[1]), pa.array(n), lists], ["row_id", "doc_id", "c1", "c2", "n", "bands"])

    return rows.select("row_id", "doc_id", "text").mapInArrow(scan, "row_id long, doc_id long, c1 long, c2 long, n long, bands array<long>")


def compare_bags(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, np.ndarray]:
    """Shared and joint size of two multisets (sorted shingles, counts), and a hash of each copy of a shingle that b has beyond a."""
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    held = np.where(a[0][at] == b[0], a[1][at], 0) if len(a[0]) else np.zeros(len(b[0]), np.int64)
    both = int(np.minimum(held, b[1]).sum())
    more = b[1] - np.minimum(held, b[1])
    copy = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    return both, int(a[1].sum() + b[1].sum()) - both, mix(np.repeat(b[0], more) + copy.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _bag_of(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    for _, _, data, offsets in text_slices(pa.array([text], pa.large_string())):
        words, first, _, _ = hashed_words(data, offsets)
        _, s, c = bags(words, first, k)
        return s, c
    return np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _verified(pairs: DataFrame, rows: DataFrame, k: int, extra: bool = False) -> DataFrame:
    """(lead, member, shared, total[, extra]) of pairs (lead, member) of row ids, over their whole multisets.

    Pairs are dealt by leader and, where a leader has many, by a salt of the member; each leader's text
    goes to each of its salts once and each member's text once per leader. ``extra`` lists the copies of shingles that the member
    has beyond the leader.
    """
    fans = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("long").alias("salts"))
    dealt = pairs.join(fans, "lead").select("lead", "member", F.pmod(F.xxhash64("member"), F.col("salts")).alias("salt"))
    texts = rows.select("row_id", "text")
    members = dealt.join(texts.withColumnRenamed("row_id", "member"), "member").select("lead", "salt", "member", "text")
    leads = (
        fans.join(texts.withColumnRenamed("row_id", "lead"), "lead")
        .select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(-1).cast("long").alias("member"), "text")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, bag = None, None
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("lead", "member", "shared", "total", "extra")}
            for row_lead, member, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if member < 0:  # the leader itself
                    lead, bag = row_lead, _bag_of(text, k)
                    continue
                if lead != row_lead:
                    raise ValueError("a member came before its leader")
                shared, total, more = compare_bags(bag, _bag_of(text, k))
                for c, x in zip(out, (row_lead, member, shared, total, more.view(np.int64)), strict=True):
                    out[c].append(x)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            made = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made if extra else made[:4], list(out)[: len(made) if extra else 4])

    # Sorted so that a leader's text comes before its members'; one bag of either kind is in memory at a time.
    both = members.unionByName(leads).repartition(F.col("lead"), F.col("salt")).sortWithinPartitions("lead", "salt", "member")
    schema = "lead long, member long, shared long, total long" + (", extra array<long>" if extra else "")
    return both.select("lead", "member", "text").mapInArrow(compare, schema)


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (id, class) after links (a, b) between ids: class is the least id of the connected component.

    Works on the graph of classes that links connect: rounds of least neighbours, then of shortened paths, until nothing changes.
    """
    ends = links.join(classes.select(F.col("id").alias("a"), F.col("class").alias("u")), "a").join(classes.select(F.col("id").alias("b"), F.col("class").alias("v")), "b")
    edges = ends.where("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct()
    edges = written(edges, "near-edges")
    names = written(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("name")), "near-names")
    moved = names.limit(1).count() > 0
    if not moved:
        return classes
    while moved:
        spread = edges.join(names.select(F.col("u").alias("v"), F.col("name").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        hooked = names.join(spread, "u").select("u", "name", F.least("name", "other").alias("new"))
        paths = hooked.select(F.col("u").alias("new"), F.col("new").alias("up"))
        new = written(hooked.join(paths, "new", "left").select("u", "name", F.least("new", F.coalesce("up", "new")).alias("new")), "near-names")
        moved = new.where("name <> new").limit(1).count() > 0
        names = new.select("u", F.col("new").alias("name"))
    return written(classes.join(names.withColumnRenamed("u", "class"), "class", "left").select("id", F.coalesce("name", "class").alias("class")), "near-classes")


def _about(compared: DataFrame, asked: DataFrame, classes: DataFrame) -> DataFrame:
    """What is known of each member against its pivot: size, class, overlap, shingles beyond it, and whether the pivot is in another class."""
    about = compared.join(asked.select("lead", "member", "n"), ["lead", "member"])
    about = about.join(classes.select(F.col("id").alias("member"), "class"), "member").join(classes.select(F.col("id").alias("lead"), F.col("class").alias("main")), "lead")
    return written(about.select("lead", "member", "n", "class", "shared", "extra", (F.col("class") != F.col("main")).alias("outside")), "near-about")


def _links_of_buckets(bucket: DataFrame, rows: DataFrame, k: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Classes (id, class) of the members of buckets (key, row_id, n), and the links (a, b) that were verified.

    No pair of a bucket is left open, and few are compared:

    1. Every member is compared with one leader per bucket.
    2. In buckets that then hold several classes the member nearest to the leader becomes the pivot, and all are
       compared with it. What members have beyond the pivot is kept.
    3. The same once more with the member nearest to what most members of the pivot's groups have.
    4. With o the overlap with that pivot, two members share at most min(o, o') plus what they share beyond
       the pivot. So further pairs need either enough in common beyond the pivot or an o of both that is large
       enough by itself; only such pairs of different classes are compared. What they have in common is counted before any text
       is fetched, and shingles that just the same members have count as one with a weight.
    """
    of = F.lit(similarity / (1 + similarity) - 1e-9)
    near = F.col("shared") >= F.col("total") * F.lit(similarity)
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * F.lit(similarity)
    as_links = lambda df: df.where(near).select(F.col("lead").alias("a"), F.col("member").alias("b"))
    nodes = bucket.select(F.col("row_id").alias("id")).distinct()

    # Leaders go by the hash of the row, so that bands with common members agree on one.
    leaders = bucket.groupBy("key").agg(F.min_by(F.struct("row_id", "n"), F.xxhash64("row_id")).alias("l"), F.count(F.lit(1)).alias("size"))
    led = bucket.join(leaders, "key").where("row_id <> l.row_id")
    pairs = led.where(fits("n", "l.n")).select(F.col("l.row_id").alias("lead"), F.col("row_id").alias("member")).distinct()
    first = written(_verified(pairs, rows, k), "near-first")
    links = as_links(first)
    classes = _merged(written(nodes.select("id", F.col("id").alias("class")), "near-classes"), links)

    # Buckets of three and more that hold several classes, with their pivot.
    named = bucket.join(classes.select(F.col("id").alias("row_id"), "class"), "row_id")
    split = named.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("c0"), F.max("class").alias("c1")).where("size > 2 AND c0 <> c1").select("key")
    open_ = written(named.join(split, "key").select("key", "row_id", "n"), "near-open")
    close = first.select("lead", F.col("member").alias("row_id"), (F.col("shared") / F.col("total")).alias("sim")).where(F.col("sim") >= similarity)
    pivots = (
        open_.join(leaders.select("key", F.col("l.row_id").alias("lead")), "key").join(close, ["lead", "row_id"], "left")
        .withColumn("sim", F.when(F.col("row_id") == F.col("lead"), 0.0).otherwise(F.col("sim")))  # the leader, where nobody is near
        .groupBy("key").agg(F.max_by(F.struct("row_id", "n"), F.when(F.col("sim").isNotNull(), F.struct("sim", F.xxhash64("row_id").alias("h")))).alias("p"))
    )
    asked = open_.join(pivots, "key").where("row_id <> p.row_id").select(F.col("p.row_id").alias("lead"), F.col("p.n").alias("lead_n"), F.col("row_id").alias("member"), "n").distinct()
    asked = written(asked, "near-asked")
    second = written(_verified(asked.select("lead", "member"), rows, k, extra=True), "near-second")
    links = links.union(as_links(second))
    classes = _merged(classes, as_links(second))
    about = _about(second, asked, classes)

    # The pivot has edits of its own, and all others share what these replaced. The member nearest to what most of
    # them have takes its place, so that little is common beyond it.
    mixed = about.where("outside").select("lead").distinct()
    group = written(about.join(mixed, "lead"), "near-group")
    most = group.groupBy("lead").agg(F.count(F.lit(1)).alias("of"))
    usual = group.select("lead", F.explode("extra").alias("s")).groupBy("lead", "s").agg(F.count(F.lit(1)).alias("c")).join(most, "lead").where("c * 2 > of").select("lead", "s")
    gained = group.select("lead", "member", F.explode("extra").alias("s")).join(usual, ["lead", "s"]).groupBy("lead", "member").agg(F.count(F.lit(1)).alias("gain"))
    score = (F.col("shared") + F.coalesce("gain", F.lit(0))) / F.col("n")
    centre = (
        group.join(gained, ["lead", "member"], "left").groupBy("lead")
        .agg(F.max_by(F.struct("member", "n"), F.struct(score.alias("score"), F.xxhash64("member").alias("h"))).alias("m"))
    )
    asked = group.join(centre, "lead").where("member <> m.member").select(F.col("m.member").alias("lead"), F.col("m.n").alias("lead_n"), "member", "n").distinct()
    asked = written(asked, "near-asked")
    nearer = written(_verified(asked.select("lead", "member"), rows, k, extra=True), "near-centre")
    links = links.union(as_links(nearer))
    classes = _merged(classes, as_links(nearer))
    about = _about(nearer, asked, classes)
    side = lambda df, x: df.select(*[c for c in df.columns if c in ("lead", "s")], *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c not in ("lead", "s", "extra")])
    least = of * (F.col("x_n") + F.col("y_n"))
    beyond = about.select("lead", "member", "n", "class", "shared", "outside", F.explode("extra").alias("s"))
    holders = beyond.groupBy("lead", "s").agg(
        F.min("class").alias("c0"), F.max("class").alias("c1"), F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("member")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "member")).alias("h2")
    )
    alike = holders.where("c0 <> c1").groupBy("lead", "c", "h1", "h2").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("w")).select("lead", "s", "w")
    beyond = written(beyond.join(alike, ["lead", "s"]), "near-beyond")
    beyond = beyond.join(beyond.groupBy("lead", "member").agg(F.sum("w").alias("most")), ["lead", "member"])  # what a member can share beyond the pivot at most
    once = ~F.col("x_outside") | (F.col("x_member") < F.col("y_member"))
    other = (F.col("x_class") != F.col("y_class")) & fits(F.col("x_n"), F.col("y_n")) & once
    by_shingle = (
        side(beyond.where("outside"), "y").join(side(beyond, "x").drop("x_w"), ["lead", "s"])
        .where(other & (F.least("x_shared", "y_shared") + F.least("x_most", "y_most") >= least))
        .groupBy("lead", "x_member", "y_member").agg(F.sum("y_w").alias("both"), *[F.first(c).alias(c) for c in ("x_n", "y_n", "x_shared", "y_shared")])
        .where(F.least("x_shared", "y_shared") + F.col("both") >= least)
    )
    large = about.where(F.col("shared") >= F.col("n") * F.lit(similarity - 1e-9))
    by_overlap = side(large.where("outside"), "y").join(side(large, "x"), "lead").where((F.col("x_shared") >= least) & (F.col("y_shared") >= least) & other)
    rest = (
        by_shingle.select("x_member", "y_member").unionByName(by_overlap.select("x_member", "y_member"))
        .select(F.least("x_member", "y_member").alias("lead"), F.greatest("x_member", "y_member").alias("member")).distinct()
    )
    third = written(_verified(written(rest, "near-rest"), rows, k), "near-third")
    return _merged(classes, as_links(third)), links.union(as_links(third)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(documents: DataFrame, k: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, stored: bool = False) -> DataFrame:
    """Classes of near duplicates: row_id, doc_id, class_id, class_row, n_links for every row.

    Two texts are linked when the weighted Jaccard similarity of their shingle multisets is at least
    ``similarity``; classes are the connected components. ``class_id`` is the doc_id of the class's first row (least
    doc_id, then row), ``class_row`` its row id, ``n_links`` the row's links that were verified on the way plus,
    for texts with the same multiset, those to the first of them. Texts of fewer than k words are one shingle; null,
    empty and wordless texts are classes of their own; null ids come first. Repeated rows are copies of each other. Rows are numbered by ``row_col``,
    for a ``stored`` table just as ``spark.read`` gives it by file and place, else in a written copy.
    """
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    rows = keyed(documents.select(*columns), "near-rows", "row_id", stored) if row_col is None else documents.select(F.col(row_col).alias("row_id"), *columns)
    scanned = written(_scan(rows, k, bands, band_rows), "near-scan")
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "row_id")
    # One row per multiset; copies are counted where they lie before anything is shuffled.
    same = scanned.where("n > 0").groupBy("c1", "c2", "n").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("copies"))
    bucket = (
        scanned.where("n > 0").select("row_id", "n", "bands", "c1", "c2")
        .join(same.select("c1", "c2", "n", F.col("o.row_id").alias("row_id")), ["c1", "c2", "n", "row_id"], "left_semi")
        .select("row_id", "n", F.posexplode("bands").alias("band", "key"))
    )
    sizes = bucket.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    bucket = written(bucket.join(sizes.select("key"), "key").select("key", "row_id", "n"), "near-buckets")
    classes, links = _links_of_buckets(bucket, rows, k, similarity)
    first = same.select("c1", "c2", "n", F.col("o.row_id").alias("rep"), "copies")
    out = scanned.select("row_id", "doc_id", "c1", "c2", "n").join(first, ["c1", "c2", "n"], "left")
    counts = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    out = out.join(classes.select(F.col("id").alias("rep"), "class"), "rep", "left")
    out = out.join(counts, "rep", "left")
    out = out.select(
        "row_id", "doc_id", F.coalesce("class", "rep", "row_id").alias("class"),
        (F.coalesce("links", F.lit(0)) + F.when(F.col("row_id") != F.col("rep"), 1).when(F.col("row_id") == F.col("rep"), F.col("copies") - 1).otherwise(0)).cast("long").alias("n_links"),
    )
    heads = out.groupBy("class").agg(F.min(order).alias("o")).select("class", F.when(F.col("o.d") == F.lit(-(2**63)), None).otherwise(F.col("o.d")).alias("class_id"), F.col("o.row_id").alias("class_row"))
    return out.join(heads, "class").select("row_id", "doc_id", "class_id", "class_row", "n_links")


def dedup_near(documents: DataFrame, k: int = WORDS, similarity: float = SIMILARITY, stored: bool = False) -> DataFrame:
    """``documents`` with the first row of each class only, columns as they are; ``stored`` as in :func:`near_duplicates`.

    Null, empty and wordless texts all stay; of repeated rows one stays; an empty table gives an empty one.
    """
    row = free_name(documents, "__row")
    docs = keyed(documents, "near-documents", row, stored)
    keep = near_duplicates(docs, k, similarity, row_col=row).where("row_id = class_row").select(F.col("row_id").alias(row))
    return docs.join(keep, row, "left_semi").drop(row)


def op10_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True).select("doc_id", "class_id", "n_links")
