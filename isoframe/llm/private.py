"""Personal data: patterns, and terms that by corpus co-occurrence give a protected entity away.

Matches of fixed patterns are the protected entities. How strongly a term reveals an entity is
measured over the whole corpus: with n(e, t) documents that have both and n(t) documents that
have t at all, -log2(n(e, t) / n(t)) bits about e stay hidden from one who reads t. Terms that leave
no more than ``max_bits`` are spans wherever they stand, also where no entity is, and the redaction
generalises entities to their kind and removes such terms.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, hashed_words, keyed, text_slices, written

#: Fixed patterns and their order in results.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DIGITS = re.compile(r"[0-9]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def accepted(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in value.split("."))
    if kind == "card":
        digits = "".join(DIGITS.findall(value))
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(DIGITS.findall(value)) <= 15
    return True


#: What an email has before its sign, and what follows it; an ip from where a run of digits starts.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping emails: what stands before each sign starts as far left as it may, so no place is tried twice."""
    bound, at = 0, text.find("@")
    while at >= 0:
        start = bound + len(text[bound:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        bound = domain.end() if domain else at + 1
        if domain:
            yield start, bound
        at = text.find("@", bound)


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the leftmost non-overlapping matches of a kind's pattern, in time linear in the text."""
    if kind == "email":
        yield from _emails(text)
    else:
        yield from (m.span() for m in (_IP if kind == "ip" else PATTERNS[kind]).finditer(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern matches in code points, by kind and start."""
    out = []
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text or kind == "ip" and text.count(".") < 3:
            continue
        out += [(kind, s, e) for s, e in _matches(kind, text) if accepted(kind, text[s:e])]
    return out


def _entity(text: str, span: tuple[str, int, int]) -> str:
    kind, start, end = span
    value = text[start:end]
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(DIGITS.findall(value))}"


def nearby_terms(text: str, spans: list[tuple[str, int, int]], reach: int, least_chars: int):
    """(entity, term, start, end, context) for the terms among the ``reach`` words on either side of each span."""
    # Words of a window of characters that surely holds enough words where they are of common length, doubled until it does.
    covered = sorted((s, e) for _, s, e in spans)
    starts, reached = [s for s, _ in covered], [0, *accumulate((e for _, e in covered), max)]
    inside = lambda w: reached[bisect_left(starts, w.end())] > w.start()
    for kind, start, end in spans:
        entity = _entity(text, (kind, start, end))
        for side in (-1, 1):
            size = 32 * reach
            while True:
                lo, hi = (max(0, start - size), start) if side < 0 else (end, min(len(text), end + size))
                words = list(TERM.finditer(text, lo, hi))
                # A word cut by the window's far edge does not count unless that is the text's edge.
                if side < 0 and lo > 0 and words and words[0].start() == lo:
                    words = words[1:]
                if side > 0 and hi < len(text) and words and words[-1].end() == hi:
                    words = words[:-1]
                if len(words) >= reach or (lo == 0 if side < 0 else hi == len(text)):
                    break
                size *= 2
            words = words[-reach:] if side < 0 else words[:reach]
            context = " ".join(w[0] for w in words)
            for w in words:
                term = w[0].translate(_TO_LOWER)
                if len(term) >= least_chars and not term.isdigit() and not inside(w):
                    yield entity, term, w.start(), w.end(), context


_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_FOUND = "row_id long, doc_id string, base array<struct<kind:int,s:int,e:int>>, entities array<struct<entity:string,c:long>>, terms array<long>"
#: Up to so many telling terms go to the tasks as one array of 8 bytes each; more are joined by shuffle.
BROADCAST_TERMS = 200_000
SALTS = 16


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _entities(text: str, spans: list[tuple[str, int, int]], reach: int, least_chars: int) -> list[tuple[str, int]]:
    """Each entity of a text, with a hash of all the surroundings in which it stands there."""
    around = {_entity(text, span): set() for span in spans}
    for entity, _, _, _, context in nearby_terms(text, spans, reach, least_chars):
        around[entity].add(context)
    return [(entity, _hash("\n".join(sorted(x)))) for entity, x in around.items()]


def _terms(text: str, spans: list[tuple[str, int, int]], least_chars: int) -> list[int]:
    """Hashes of the different terms of a text outside its entities."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hashes = hashed_words(data, np.array([0, len(data)], np.int64))[0].view(np.int64)
    covered, at, out = sorted((s, e) for _, s, e in spans), 0, set()
    reached = 0  # the furthest end of the entities that start before the word's end
    for h, w in zip(hashes.tolist(), TERM.finditer(text), strict=True):
        while at < len(covered) and covered[at][0] < w.end():
            reached, at = max(reached, covered[at][1]), at + 1
        if reached <= w.start() and len(w[0]) >= least_chars and not w[0].isdigit():
            out.add(h)
    return list(out)


def scan(rows: DataFrame, reach: int, least_chars: int) -> DataFrame:
    """Base spans, entities and terms of each of the rows (row_id, doc_id, text)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base, entities, terms = [], [], []
            for text in pdf["text"]:
                spans = base_spans(text)
                base.append([(KINDS.index(k), s, e) for k, s, e in spans])
                entities.append(_entities(text, spans, reach, least_chars) if spans else [])
                terms.append(_terms(text, spans, least_chars) if spans else [])
            yield pd.DataFrame({"row_id": pdf["row_id"], "doc_id": pdf["doc_id"], "base": base, "entities": entities, "terms": terms})

    rows = rows.select("row_id", F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The id crosses pandas as text, which keeps nulls and all digits.
    return written(rows.mapInPandas(find, _FOUND).withColumn("doc_id", F.col("doc_id").cast("long")), "private-spans")


def term_documents(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): in how many rows each word occurs, by the word's hash; counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                words, first, _, _ = hashed_words(data, offsets)
                owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
                order = np.lexsort((owner, words))
                w, o = words[order], owner[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
                h, n = np.unique(w[new], return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": n.astype(np.int64)})

    return documents.select(F.col(text_col).alias("text")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _marked(rows: DataFrame, terms: np.ndarray | None) -> DataFrame:
    """(row_id, extra) of the rows (row_id, text) that have any of the terms, given as sorted hashes or as a column ``terms``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offsets in text_slices(batch.column(1)):
                words, first, starts, ends = hashed_words(data, offsets)
                words, owner = words.view(np.int64), np.repeat(np.arange(b - a), np.diff(first))
                if terms is not None:
                    hit = np.isin(words, terms)
                else:
                    hit = np.zeros(len(words), bool)
                    for i in range(b - a):
                        hit[first[i] : first[i + 1]] = np.isin(words[first[i] : first[i + 1]], batch.column(2)[a + i].values.to_numpy())
                owner = owner[hit]
                points = np.zeros(len(data) + 1, np.int64)  # code points before each byte
                np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                s, e = (points[x[hit]] - points[offsets[owner]] for x in (starts, ends))
                kept, n = np.unique(owner, return_counts=True)
                span = pa.StructArray.from_arrays([pa.array(np.full(len(s), len(KINDS), np.int32)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["kind", "s", "e"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), span)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][kept]), lists], ["row_id", "extra"])

    return rows.mapInArrow(mark, "row_id long, extra array<struct<kind:int,s:int,e:int>>")


def _row_terms(rows: DataFrame) -> DataFrame:
    """(row_id, h): the different words of each row, by hash."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, data, offsets in text_slices(batch.column(1)):
                words, first, _, _ = hashed_words(data, offsets)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                order = np.lexsort((words, owner))
                w, o = words[order].view(np.int64), owner[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + o[new]]), pa.array(w[new])], ["row_id", "h"])

    return rows.mapInArrow(words_of, "row_id long, h long")


def find_private(
    documents: DataFrame,
    reach: int = 8,
    least_chars: int = 4,
    least_contexts: int = 2,
    max_bits: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Spans of personal data of every row: row_id, doc_id, spans as array of (kind, s, e), kinds numbered as in KINDS + term.

    A term of at least ``least_chars`` characters is telling where it stands in documents of an entity that show the
    entity in ``least_contexts`` different surroundings of ``reach`` words (copies of a text count once) and leaves at
    most ``max_bits`` bits about it. Every occurrence of a telling term in any row is a span, other than inside an
    entity. Null and empty texts have no spans; repeated rows each get a row; other columns are not read.
    Rows are numbered by ``row_col``, for a ``stored`` table just as ``spark.read`` gives it by file and place, else in a
    written copy. Texts of any length are read whole, in time linear in their length and in their spans.
    """
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    rows = keyed(documents.select(*columns), "private-rows", "row_id", stored) if row_col is None else documents.select(F.col(row_col).alias("row_id"), *columns)
    found = scan(rows, reach, least_chars)
    each = found.select("row_id", F.explode("entities").alias("x")).select("row_id", "x.*")
    # An entity with fewer surroundings in all has no telling terms.
    often = each.groupBy("entity").agg(F.count_distinct("c").alias("k")).where(F.col("k") >= least_contexts).select("entity")
    pairs = (
        each.join(often, "entity").join(found.select("row_id", "terms"), "row_id").select("entity", "c", F.explode("terms").alias("h"))
        .groupBy("entity", "h", "c").agg(F.count(F.lit(1)).alias("both"))
        .groupBy("entity", "h").agg(F.sum("both").alias("both"), F.count(F.lit(1)).alias("contexts"))
        .where(F.col("contexts") >= least_contexts)
        .groupBy("h").agg(F.max("both").alias("both"))
    )
    telling = written(pairs.join(term_documents(rows), "h").where(F.col("both") >= F.col("n") * F.lit(2.0**-max_bits)).select("h"), "private-terms")
    rows = rows.select("row_id", F.coalesce("text", F.lit("")).alias("text"))
    if telling.count() <= BROADCAST_TERMS:
        extra = _marked(rows, np.sort(np.array([r["h"] for r in telling.collect()], np.int64)))
    else:
        salted = telling.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        per_row = _row_terms(rows).withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).groupBy("row_id").agg(F.collect_list("h").alias("terms"))
        extra = _marked(rows.join(per_row, "row_id").select("row_id", "text", "terms"), None)
    none = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    outside = F.filter(F.coalesce("extra", none), lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return found.select("row_id", "doc_id", "base").join(extra, "row_id", "left").select("row_id", "doc_id", "base", F.array_sort(F.concat("base", outside)).alias("spans"))


def redact(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", stored: bool = False, **options) -> DataFrame:
    """``documents`` with entities generalised to [KIND] and telling terms removed, other columns as they are.

    The spans are those of :func:`find_private`, with its ``options``. Null texts stay null; repeated rows are all rewritten.
    """
    labels = [f"[{k.upper()}]" for k in KINDS] + [""]

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, found in zip(pdf["text"], pdf["spans"], strict=True):
                at, parts = 0, []
                for s, e, kind in sorted((x["s"], -x["e"], x["kind"]) for x in (found if found is not None else [])):
                    if s >= at:
                        parts += [text[at:s], labels[kind]]
                    at = max(at, -e)
                out.append("".join(parts) + text[at:] if text is not None else None)
            yield pd.DataFrame({"row_id": pdf["row_id"], "__clean": out})

    row, clean = free_name(documents, "__row"), free_name(documents, "__clean")
    docs = keyed(documents, "redact-documents", row, stored)
    spans = find_private(docs, id_col=id_col, text_col=text_col, row_col=row, **options).select("row_id", "spans")
    joined = docs.select(F.col(row).alias("row_id"), F.col(text_col).alias("text")).join(spans, "row_id", "left")
    rewritten = joined.mapInPandas(rewrite, "row_id long, __clean string").toDF(row, clean)
    return docs.join(rewritten, row).withColumn(text_col, F.col(clean)).drop(row, clean)


def op8_query(spark, sf_dir: str) -> DataFrame:
    found = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    line = lambda col: F.concat_ws(",", F.transform(col, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans")
    )
