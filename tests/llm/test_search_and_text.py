import base64
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoframe.llm import decontaminate, html_text, private, topk, warc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_top(rows, asked, k):
    out = set()
    for q, v in asked:
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])}
    return out


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def test_top_k_equals_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)], 0) for i in range(700)]
    rows += [(i, [0.5] * 6, 0) for i in range(700, 1000)]  # one very common vector, all ties
    rows += [(1001, None, 0), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1003, [float("nan")] * 6, 0), (1004, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (1050, [0.1, 0.2], 0)]
    rows += rows[:3]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit("x")), "vec_id", "embedding")
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), block_rows=100).collect()}
    good = list({i: (i, whole(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}.values())
    assert got == brute_top(good, [x for x in good if x[0] % 50 == 0], 5)


def test_top_k_of_few_and_none(spark):
    few = topk.integer_vectors(spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA), "vec_id", "embedding")
    assert [tuple(r) for r in topk.top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    none = few.where("vec_id < 0")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(few, none).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(0).normal(size=(500, 4))
    stack = [topk.cover_tree(x, leaf=8)]
    while stack:
        node = stack.pop()
        assert (np.sqrt(((x[node.rows] - node.centre) ** 2).sum(1)) <= node.radius + 1e-9).all()
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        stack += node.children


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        grams = {tuple(v[j : j + n]) for j in range(max(1, len(v) - n + 1))} if v else set()
        for j in range(len(w) - n + 1):
            if tuple(w[j : j + n]) in grams:
                hit |= set(range(j, j + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [20_000, 0])
def test_decontamination_equals_brute_force(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)  # both joins give the same rows
    rnd = random.Random(2)
    word = lambda: rnd.choice("ab cd ef gh Éa ij kl".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([10, 11, 14, 30, 3, 1, 12])]
    items += [(7, None), (8, ""), (9, "... "), (3, items[3][1]), (10, "zz " * 25)]
    rows = [(i, " ".join(word() for _ in range(60)) + " " + items[i % 7][1].upper() + " tail") for i in range(30)]
    rows += [(40, None), (41, ""), (42, "zz " * 40), (43, "one two"), (None, items[3][1]), (1, rows[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.decontaminate(docs(rows), bench).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got], key=key) == sorted([(d, *brute_hits(t, items)) for d, t in rows], key=key)
    assert decontaminate.decontaminate(docs(rows[:2]), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.decontaminate(docs([]), bench).count() == 0
    kept = decontaminate.clean(docs(rows), bench)
    assert kept.columns == docs(rows).columns and kept.count() == sum(brute_hits(t, items)[1] == 0 for _, t in rows)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- c --><div class="cookie-notice">Cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text.<br>More<p>Second &eacute;&#233; <a href="x">link</a>.</p><div class="share">Share</div><form>Form<input></form><aside>Side</aside></article>
<section id="comments"><p>Reader says</p></section><footer>&copy; foot</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "", ""), (4, "http://a.example/y", "plain < text"), (None, "http://b.example", "<p>" + "long " * 50_000), (1, "http://a.example/x", PAGE)]
    got = sorted(((r.page_id or -1, r.text, r.n_chars) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))).collect()))
    text = "Head & line\n\nFirst bold text. More\n\nSecond éé link."
    assert got == [(-1, ("long " * 50_000).strip(), 249_999), (1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, "plain < text", 12)]
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_finds_furniture_without_names(spark):
    page = "<html><body><div class='x1'><p>Same strip {n}</p></div><div class='x2'><p>Own text of page {i} and no other</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i=i, n=i % 2)) for i in range(40)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Own text of page {i} and no other" for i in range(40)}


def test_statistics_decide_over_names(spark):
    page = "<html><body><div id='page-with-sidebar'><main class='has-sidebar'><article class='post share'><p>Own text {i}</p><p>Subscribe today</p></article></main></div><div class='ad'>Buy</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i=i)) for i in range(30)]
    rows += [(100 + i, f"http://m.example/{i}", "<article><p>Mirrored text</p></article>") for i in range(20)]
    rows += [(200 + i, f"http://n.example/{i}", f"<div class='social history'>Study {i} of society</div><div class='promo'>Offer {i % 2}</div>") for i in range(20)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Own text {i}" for i in range(30)}, **{100 + i: "Mirrored text" for i in range(20)}, **{200 + i: f"Study {i} of society" for i in range(20)}}
    one = spark.createDataFrame([rows[0]], "page_id long, url string, html string")
    assert html_text.main_text(one).first().text == "Own text 0\n\nSubscribe today"


def test_texts_are_not_shuffled_for_few_verdicts(spark, monkeypatch):
    page = "<html><body><div class='x1'><p>Same strip {n}</p></div><div class='x2 ad'><p>Own text of page {i} and no other</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i=i, n=i % 2)) for i in range(40)] + [(50, "http://k.example/", "<p>Alone<nav>Menu</nav>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = html_text.main_text(table)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(html_text, "BROADCAST_VERDICTS", -1)  # the join by shuffle gives the same rows
    got = sorted(map(tuple, html_text.main_text(table).collect()))
    assert got == sorted(map(tuple, few.collect())) and got[-1][2] == "Alone" and got[0][2] == "Own text of page 0 and no other"


def test_private_spans(spark, docs):
    text = "Mail a.b@c.example.org or +44 (20) 7946-0958, host 10.0.0.255, not 1.2.3.456; card 4111 1111 1111 1111, not 4111 1111 1111 1112."
    assert [(k, text[s:e]) for k, s, e in private.base_spans(text)] == [
        ("email", "a.b@c.example.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+44 (20) 7946-0958"),
    ]
    assert private.accepted("ip", "0001.2.3.4") and not private.accepted("ip", "9999999999.1.1.1")


def test_telling_terms(spark, docs):
    rows = [(i, f"é variant {i} zanzibarian writes to x@y.example.org about common matters") for i in range(4)]
    rows += [(10 + i, f"these are common matters number {i} for all about") for i in range(8)]
    rows += [(30, None), (31, ""), (None, "no one"), (0, rows[0][1])]
    found = private.find_private(docs(rows))
    terms = {(r.doc_id, rows[0][1][x.s : x.e]) for r in found.collect() for x in r.spans if x.kind == 4 and r.doc_id == 0}
    assert {t for _, t in terms} == {"variant", "zanzibarian", "writes"}
    assert found.count() == len(rows)
    clean = {r.doc_id: r.text for r in private.redact(docs(rows)).collect()}
    assert clean[0] == "é  0   to [EMAIL] about common matters" and clean[30] is None and clean[10] == rows[4][1]
    assert private.find_private(docs([])).count() == 0


@pytest.mark.parametrize("bound", [200_000, 0])
def test_telling_terms_go_wherever_they_stand(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(private, "BROADCAST_TERMS", bound)
    far = "one two three four five six seven eight nine ten"
    rows = [(i, f"sender {i * 7} wrote to x@y.example.org and {far} Zanzibarian é{i} zanzibarian") for i in range(3)]
    rows += [(10, "é here only zanzibarian is left"), (11, f"sender wrote {far} and example"), (12, f"sender wrote {far}"), (13, f"sender wrote {far}"), (14, f"sender wrote {far}")]
    text = dict(rows)
    got = {r.doc_id: [text[r.doc_id][x.s : x.e] for x in r.spans if x.kind == 4] for r in private.find_private(docs(rows)).collect()}
    assert got == {**{i: ["Zanzibarian", "zanzibarian"] for i in range(3)}, 10: ["zanzibarian"], **{i: [] for i in range(11, 15)}}


def test_warc_round_trip(spark):
    rows = [(3, "http://a/%0A\r\n", "same"), (2, None, "same"), (5, "u", "é" * 100_000), (7, "u", None), (6, "u", ""), (None, "n", "same"), (2, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d"))
    archives = warc.write_archives(pages, roll_bytes=200)
    assert archives.count() > 1
    got = sorted((r.asDict() for r in warc.read_archives(archives, with_payload=True).collect()), key=lambda r: (r["page_id"] or 0, r["record_type"]))
    first = {"same": 2, "": 6}
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        data = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        refers = first.get(html, r["page_id"])
        assert r["refers_to"] == (refers if refers != r["page_id"] else None)
        assert r["payload"] == (bytearray(data) if r["record_type"] == "response" else None)
    assert {r["url"] for r in got} == {u for _, u, _ in rows}
    empty = pages.limit(0)
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_damaged_records_are_refused():
    import io

    data = warc.record_bytes(1, "u", b"payload", None)
    assert [warc.parse_record(m)["payload"] for m in warc.gzip_members(io.BytesIO(data + data))] == [b"payload"] * 2
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.gzip_members(io.BytesIO(data[:-9])))
    plain = next(warc.gzip_members(io.BytesIO(data)))
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(plain.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


@pytest.mark.parametrize(
    "source",
    ["<a " * 200_000, "<b>" * 100_000 + "x<div>y</div>" * 1000, "<a \"<b '" * 80_000, "<!" * 300_000, "<div>" * 5_000 + "deep" + "</div>" * 5_000, "<span>" * 50_000 + "<li></li>" * 20_000],
)
def test_broken_and_deep_pages_take_linear_time(source):
    started = time.monotonic()
    blocks, _ = html_text.read_page(source)
    assert all(e.furniture() is False for e, _ in blocks)
    assert time.monotonic() - started < 20


def test_markup_with_quotes_and_brackets():
    read = lambda s: [t for _, t in html_text.read_page(s)[0]]
    assert read("<p title='a > b'>one</p><p title=\"<p>\">two</p>") == ["one", "two"]
    assert read("<p>x <a href=\"u>y</p><p>z</p>") == ["x <a href=\"u>y", "z"]
    assert read("<![CDATA[in]]><!-- out --><?x?>after") == ["inafter"]


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1." * 100_000, "a@" * 300_000, "a" * 1_000_000 + "@", "ab@cd.ef word " * 4000])
def test_long_runs_take_linear_time(text):
    started = time.monotonic()
    spans = private.base_spans(text)
    for _ in private.nearby_terms(text, spans, 8, 4):
        pass
    assert time.monotonic() - started < 20


def test_base_spans_equal_the_plain_patterns():
    pick = random.Random(3)
    for _ in range(4000):
        text = "".join(pick.choice("a1.@-+_ 2 ..@@99é") for _ in range(pick.randint(0, 60)))
        plain = [(k, m.start(), m.end()) for k in private.KINDS for m in private.PATTERNS[k].finditer(text) if private.accepted(k, m[0])]
        assert private.base_spans(text) == plain
