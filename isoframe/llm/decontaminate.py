"""Benchmark decontamination by winnowed fingerprints, in DataFrame functions only.

Every text becomes its words. The hash of k consecutive words is a fingerprint where it is the least
of some window of ``window - k + 1`` such hashes. Two texts that share ``window`` words share such a
window and so a fingerprint at the same place in it; a matching fingerprint is extended word by word
in both directions, and what reaches ``window`` words is a hit. Ties keep all positions of the least
hash, so the guarantee also holds inside repeated words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, keyed, words_of

#: A fingerprint table of up to so many rows (about 300 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def _hash_at(hashed: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(hashed, i + j) for j in range(n)])


def _positions(n: Column) -> Column:
    """0 .. n-1; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _hashed(df: DataFrame, k: int) -> DataFrame:
    """Adds ``wh``, the hash of each word, and ``hs``, the hash of the k words from each position on."""
    df = df.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    return df.withColumn("hs", F.transform(_positions(F.size("wh") - (k - 1)), lambda i: _hash_at(F.col("wh"), i, k)))


def _winnowed(df: DataFrame, width: int) -> DataFrame:
    """Adds ``picks``, the positions of the fingerprints, for the rows where ``may_match`` holds.

    A position is a fingerprint where the greatest of the minima of the windows that hold it is its own
    hash. Windows that reach over an end count with what they hold, which only adds fingerprints.
    """
    # ``low`` starts width - 1 places before the text, so that every position lies in width windows.
    least = (lambda j: F.least(*[F.get("hs", j - (width - 1) + t) for t in range(width)])) if width > 1 else (lambda j: F.get("hs", j))
    held = F.when(F.col("may_match"), F.size("hs")).otherwise(0)
    df = df.withColumn("low", F.transform(_positions(F.when(held > 0, held + (width - 1)).otherwise(0)), least))
    top = (lambda i: F.greatest(*[F.get("low", i + t) for t in range(width)])) if width > 1 else (lambda i: F.get("low", i))
    return df.withColumn("picks", F.filter(_positions(held), lambda i: F.get("hs", i) == top(i)))


def _has_gram(size: int, hashes: list[int]) -> Column:
    return F.exists(_positions(F.size("w") - (size - 1)), lambda i: _hash_at(F.col("wh"), i, size).isin(hashes))


def _before(w: Column, i: Column, reach: int) -> Column:
    return F.reverse(F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))))


def _run(pairs: list[Column]) -> Column:
    """How many of the equalities hold from the first on."""
    out = F.lit(len(pairs))
    for i, same in reversed(list(enumerate(pairs))):
        out = F.when(F.coalesce(same, F.lit(False)), out).otherwise(F.lit(i))
    return out


def fingerprints(items: DataFrame, item_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """(kind, h, item_id, gram, left, right) of the benchmark; equal rows of one item are kept once.

    ``left`` and ``right`` hold the up to ``window - k`` words around the fingerprint, nearest first.
    An item of fewer words than ``window`` has one row of kind = its length.
    """
    reach = window - k
    rows = items.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0).distinct()
    w, i = F.col("w"), F.col("i")
    long = (
        _winnowed(_hashed(rows.where(F.size("w") >= window), k).withColumn("may_match", F.lit(True)), reach + 1)
        .select("item_id", "w", "hs", F.explode_outer("picks").alias("i"))  # plain explode would push its filter into the lambdas
        .select(
            F.lit(0).alias("kind"), F.get("hs", i).alias("h"), "item_id", F.slice(w, i + 1, k).alias("gram"),
            _before(w, i, reach).alias("left"), F.slice(w, i + k + 1, reach).alias("right"),
        )
    )
    none = F.array().cast("array<string>")
    # xxhash64 passes over nulls, so reading beyond the end of a short item hashes just its words.
    short = rows.where(F.size("w") < window).select(
        F.size("w").alias("kind"), _hash_at(F.transform(w, lambda x: F.xxhash64(x)), F.lit(0), window - 1).alias("h"), "item_id",
        w.alias("gram"), none.alias("left"), none.alias("right"),
    )
    return long.unionByName(short).distinct()


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    k: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item.

    Returns per row of ``documents``: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), row_id.
    Null and empty texts have no words and no hits; items without words match nothing; null item ids
    are left out of ``item_ids``. Repeated rows each get their own result row; ``row_col`` names the column
    that tells them apart, else one scan numbers them. Only the named columns of either table are read, so
    further columns do not matter. Texts of any length are read whole, in one row each.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and window")
    reach = window - k
    prints = fingerprints(benchmark, item_col, item_text_col, window, k)
    sizes = prints.groupBy("kind").count().collect()  # one row per length below the window
    short = sorted(r["kind"] for r in sizes if r["kind"])
    may_match = F.lit(True)
    if sum(r["count"] for r in sizes) <= BROADCAST_ROWS:
        # Few fingerprints: texts without any of their hashes need no windows. More of them are joined by shuffle.
        by_kind = {n: [r["h"] for r in prints.where(F.col("kind") == n).select("h").distinct().collect()] for n in [0, *short]}
        prints = F.broadcast(prints)
        may_match = F.exists("hs", lambda h: h.isin(by_kind[0])) if by_kind[0] else F.lit(False)
        for n in short:
            may_match = may_match | _has_gram(n, by_kind[n])
    w, i = F.col("w"), F.col("i")
    docs = documents.select(
        (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row_id"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w")
    )
    none = F.array().cast("array<string>")

    def key(kind, h, at, here, left, right):
        return F.struct(kind.alias("kind"), h.alias("h"), at.alias("i"), here.alias("here"), left.alias("before"), right.alias("behind"))

    def grams(size: int):
        here = _positions(F.when(F.col("may_match"), F.size(w) - (size - 1)).otherwise(0))
        return F.transform(here, lambda i: key(F.lit(size), _hash_at(F.col("wh"), i, size), i, F.slice(w, i + 1, size), none, none))

    # One row without a key carries the word count; the others are fingerprints and grams of the short items' lengths.
    kinds = [
        F.array(key(F.lit(-1), F.lit(0).cast("long"), F.lit(0), none, none, none)),
        F.transform("picks", lambda i: key(F.lit(0), F.get("hs", i), i, F.slice(w, i + 1, k), _before(w, i, reach), F.slice(w, i + k + 1, reach))),
    ] + [grams(n) for n in short]
    at = (
        _winnowed(_hashed(docs, k).withColumn("may_match", may_match), reach + 1)
        .select("row_id", "doc_id", F.size("w").alias("n_words"), F.explode_outer(F.concat(*kinds)).alias("key"))
        .select("row_id", "doc_id", "n_words", "key.*")
    )
    found = at.join(prints, ["kind", "h"], "left").where(F.col("item_id").isNotNull() | (F.col("kind") < 0))
    back = _run([F.get("before", F.lit(j)) == F.get("left", F.lit(j)) for j in range(reach)])
    ahead = _run([F.get("behind", F.lit(j)) == F.get("right", F.lit(j)) for j in range(reach)])
    same = F.slice("here", 1, F.size("gram")) == F.col("gram")
    spans = found.select(
        "row_id", "doc_id", "n_words", "item_id", "i", "kind",
        same.alias("same"), F.when(F.col("kind") == 0, back).otherwise(0).alias("back"), F.when(F.col("kind") == 0, ahead).otherwise(0).alias("ahead"),
    ).withColumn("size", F.when(F.col("kind") == 0, k).otherwise(F.col("kind")))
    hit = F.coalesce((F.col("kind") >= 0) & F.col("same") & ((F.col("kind") > 0) | (F.col("back") + F.col("ahead") >= reach)), F.lit(False))
    span = F.when(hit, F.struct((i - F.col("back")).alias("s"), (i + F.col("size") + F.col("ahead")).alias("e")))
    per = spans.groupBy("row_id", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"), F.collect_set(F.when(hit, F.col("item_id").cast("string"))).alias("items")
    )
    union = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["e"] - F.greatest(s["s"], a["e"]), F.lit(0))).alias("n"), F.greatest(a["e"], s["e"]).alias("e")
        ),
    )["n"]
    return per.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        union.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("item_ids"),
        "row_id",
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, stored: bool = False) -> DataFrame:
    """The rows of ``documents`` without any benchmark hit, with their columns as they are.

    Hits are traced by row and not by an id that may repeat or be null. For a ``stored`` table just as ``spark.read`` gives
    it rows are numbered by file and place, else in a written copy. Null and empty texts stay; an empty benchmark
    removes nothing.
    """
    row = free_name(documents, "__row")
    docs = keyed(documents, "clean-documents", row, stored)
    hits = decontaminate(docs, benchmark, window, k, row_col=row).where("n_hit > 0").select(F.col("row_id").alias(row))
    return docs.join(hits, row, "left_anti").drop(row)


def op4_query(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
