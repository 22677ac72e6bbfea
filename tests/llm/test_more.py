"""Pages, vectors, conversations, archives and the pipeline, against brute force or DuckDB, with odd rows."""

import hashlib
import html
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import bpe, chat, extract, registry, topk, warc

from .data import frame, tables, text

# Main text


def main_text(source):
    out, last = "", None
    for block, _, _, t in extract.Page(source).kept():
        out += (" " if last not in (None, block) else "") + t
        last = block
    return re.sub(" +", " ", out).strip()


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b &amp c<br>d<b>e</b>f", "a b & c def"), ("<nav>x</nav><div>y</div><footer>z", "y"),
        ("<article><header><h1>T</h1></header><p>a</p><div class='comments'><p>c</p></div></article><p>out</p>", "T a"),
        ("<header><h1>Site</h1></header><main><p>x &lt;b&gt; y</p><script>if(a<b){}</script><form><input>q</form>z</main>", "x <b> y z"),
        ("<article><p>1 < 2 and <3 <a href='>'>link</a></p><!-- c", "1 < 2 and <3 link"), ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a b 1 2 3"),
        ("<div id='cookie-notice'>c</div>text<script>x", "text"), ("<p>a&nbsp;&#65;&am;</p>", "a A&am;"), ("<div><div><p>deep</div>", "deep"), ("</p></div>x", "x"),
        ("<article>one <span class='ad'>buy</span>two</article>", "one two"), ("<" * 3000, "<" * 3000), ("<a " * 2000, ""),
    ],
)
def test_pages(source, want):
    got = main_text(source)
    assert got == want or source.startswith("<a ")


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<nav>m</nav><main class='content no-sidebar'><p>the text</p></main>", "the text"), ("<article class='post has-comments'>the text</article><p>out</p>", "the text"),
        ("<div class='layout-with-sidebar'><p>the text</p><div class='sidebar'>s</div></div>", "the text"), ("<section class='notice'><h1>T</h1><p>the text</p></section>", "T the text"),
        ("<section class='notice'><article>the text<div class='share'>s</div></article></section>", "the text"), ("<article class='related'>the text</article>", "the text"),
        ("<article>the text</article><div class='comments'>longer than the text</div>", "the text"), ("<div class='related'><nav>x</nav>links</div><p>the text</p>", "the text"),
        ("<div class='widget'>" * 3000 + "the text", "the text"),
    ],
)
def test_class_names_are_a_weak_prior(source, want):
    assert main_text(source) == want


def site(n, host, body):
    frame_ = "<body><div class='top'>Welcome to the shop</div><div class='c{i}'><h2>Story</h2><p>{b}</p></div><div class='low'>All rights belong to us</div></body>"
    return [(i, f"http://{host}/{i}", "<html>" + frame_.format(i=i, b=body(i))) for i in range(n)]


def test_entropy_removes_what_all_pages_share(spark):
    pages = site(12, "a.example", lambda i: text(20, i)) + [(100, "http://b.example/", site(1, "b", lambda i: "alone")[0][2]), (101, None, None), (101, None, None), (102, "x", "")]
    got = {r["page_id"]: r["text"] for r in extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert text(20, i) in got[i] and "Welcome" not in got[i] and "rights" not in got[i]
    assert got[100] == "Welcome to the shop Story alone All rights belong to us" and got[101] == got[102] == ""
    assert extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    tree = extract.style_tree(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert tree.where("importance < -1e-9 OR importance > 1 + 1e-9").count() == 0


def test_entropy_overrules_declarations_and_judges_few_pages(spark):
    page = lambda i, body: f"<article><h1>Story {i}</h1><p>{body}</p><div class='box'>Tell your friends</div></article>"
    pages = [(i, f"http://a.example/{i}", page(i, text(20, i))) for i in range(6)] + [(10 + i, f"http://same.example/{i}", page(0, text(20, 1))) for i in range(6)]
    pages += [(20 + i, f"http://two.example/{i}", f"<div class='bar'>Home Shop Contact</div><div class='t'>{text(20, i)}</div>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} {text(20, i)}" for i in range(6))
    assert all(got[i] == f"Story 0 {text(20, 1)} Tell your friends" for i in range(10, 16))
    assert [got[20], got[21]] == [text(20, 0), text(20, 1)]


def test_pages_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in extract.op1_extract(spark, d).collect()}
    for i, source in duckdb.sql(f"SELECT page_id, html FROM '{d}/pages.parquet'").fetchall():
        article = re.search("<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[i] == " ".join(b for b in blocks if b)


# Top-k


def test_topk_against_a_full_scan(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(700)] + [(1000, [0.5] * 8), (1001, [0.5] * 8), (1002, [0.5] * 8)]
    vectors += [(2000, None), (2100, []), (2200, [1.0, None] * 4), (2300, [float("nan")] * 8), (2400, [float("inf")] * 8), (2500, [1.0] * 3), (2600, [1.0] * 3), (None, [1.0] * 8)]
    vectors += [(7, [9.0] * 8), (100, [0.1] * 8), (2700, [0.0] * 8), (3000, [-0.001] * 8), (3100, [1e30] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in topk.search(topk.index(df), df.where("vec_id % 100 = 0"), 10).collect())
    good = []
    for i, v in vectors:
        if i is not None and v and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e9:
            good.append((i, [int(x) for x in np.floor(1024 * np.array(v, np.float32).astype(float))]))
    want = []
    asked = {}
    for i, v in vectors:
        if i is not None and i % 100 == 0 and v is not None:
            asked.setdefault(i, []).append([x if x is None else np.float32(x) for x in v])
    for q, vs in asked.items():
        own = min(vs, key=lambda v: [(-1, 0) if x is None else (0, float(x)) for x in v])
        x = topk.integers(own)
        if x is None:
            continue
        scored = sorted(((-int(np.dot(x, v)), i) for i, v in good if i != q and len(v) == len(x)))[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert got == sorted(want)
    assert topk.search(topk.index(df.limit(0)), df.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(6)
    sizes = (0.1, 20_000.0, 1e6, 1e9, 1e14)
    vectors = [(i, [float(x) for x in rng.normal(0, sizes[i % 5], 4)]) for i in range(400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(2)
    got = sorted(tuple(r) for r in topk.search(topk.index(df), df.where("vec_id % 100 = 0 OR vec_id % 100 = 51"), 10).collect())
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors]
    want = []
    for q, x in whole:
        if q % 100 in (0, 51):
            scored = sorted((-s, i) for i, v in whole if i != q and -(2**63) <= (s := sum(a * b for a, b in zip(x, v))) < 2**63)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:10], 1)]
    assert got == sorted(want)


def test_slices():
    rng = np.random.default_rng(5)
    for rows, length, spread in ((1, 1, 1), (63, 3, 5), (64, 5, 100), (130, 64, 600), (200, 4, 0)):
        values = rng.integers(-spread, spread + 1, (rows, length))
        block = topk.Block.of(np.arange(rows), values)
        for _ in range(5):
            q = rng.integers(-spread, spread + 1, length)
            ids, scores = block.top(q, -1, 10)
            want = sorted((-int(values[i] @ q), i) for i in range(rows))[:10]
            assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == want


# Chat


def test_hostile_turns_come_back(spark):
    rng = random.Random(6)
    said = ["".join(rng.choice("<|\\>im_endstar\n a") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", None, chat.HOSTILE, "<|", "<\\|", "<\\\\|im_end|>\n", "<"]
    turns = [(c, t, ("user", "assistant")[t % 2], rng.choice(said)) for c in range(100) for t in range(rng.randint(1, 6))]
    turns += [(200, 0, None, "x"), (201, 0, "system", "s"), (201, 1, "user", "u"), (201, 2, "assistant", None), (None, None, "user", "n"), (202, 1, "user", "same"), (202, 1, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert len(got) == len({t[0] for t in turns})
    for c, r in got.items():
        mine = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c), key=lambda x: (x[0] is not None, x))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [m[1:] for m in mine]
        assert r["learned"] == "".join(m[2] for m in mine if m[1] == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["text"]
    assert got[201]["valid"] and not got[202]["valid"] and got[202]["state"] == "reject" and not got[200]["valid"]
    assert chat.formatted(df.limit(0)).count() == 0


# WARC


def replicas(spark):
    pages = [(i, f"http://h/{i}", text(30 + i % 50, i) * (1 + i % 7)) for i in range(600)] + [(5000, "u", None), (5000, "u", None), (None, None, "lost")]
    return warc.records(spark.createDataFrame(pages, "page_id long, url string, html string"))


def test_audit_finds_just_the_damage(spark):
    laid = replicas(spark)
    whole = laid.orderBy("archive", "offset").collect()
    for a, b in zip(whole, whole[1:], strict=False):
        assert a["archive"] != b["archive"] or a["offset"] + a["length"] == b["offset"]
    ours = warc.leaves(laid)
    assert warc.audit(ours, ours).count() == 0
    bad = laid.where("page_id IS NULL OR page_id <> 77").withColumn("record", F.when(F.col("page_id") == 300, F.lit(b"x")).otherwise(F.col("record")))
    extra = spark.createDataFrame([(0, 10**7, 3, 1, bytearray(b"new")), (99, 0, 3, 1, bytearray(b"new"))], laid.schema)
    got = sorted((r["archive"], r["status"]) for r in warc.audit(ours, warc.leaves(bad.unionByName(extra))).collect())
    assert got == [(0, "changed"), (0, "extra"), (0, "missing"), (99, "extra")]
    lost = warc.audit(ours, ours.where("archive IS NOT NULL"))
    assert [r["status"] for r in lost.collect()] == ["missing"]
    none = ours.limit(0)
    assert warc.audit(none, none).count() == 0 and warc.audit(ours, none).count() == len(whole)


def test_tree_digests(spark):
    ours = warc.leaves(replicas(spark)).where("archive = 0")
    levels = warc.tree(ours)
    low = {}
    for r in sorted(ours.collect(), key=lambda r: r["offset"]):
        low.setdefault(r["offset"] // warc.RANGE, []).append(r["leaf"])
    want = {n: hashlib.sha256("".join(ls).encode()).hexdigest() for n, ls in low.items()}
    assert {r["node"]: r["digest"] for r in levels[0].collect()} == want
    assert levels[-1].count() == 1


# The registered queries


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want, got = c.execute(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, d).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_text = lambda x: x[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert as_text(got).equals(as_text(want))


def test_registered():
    names = set(registry.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 11)) and "pipeline" in names


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    prose = lambda seed, n: " ".join(random.Random(seed).choice("abcdefgh") + str(random.Random(seed * 1000 + k).randint(0, 999)) for k in range(n))
    docs = [(i, prose(i, 80)) for i in range(60)] + [(100, prose(5, 80)), (101, prose(70, 60) + " " + prose(900, 40) + " " + prose(71, 60)), (102, "mail a@b.co now"), (103, ""), (104, None)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = tables(spark, tmp_path, documents=frame(spark, docs), labels=labels, benchmark=spark.createDataFrame([(1, prose(900, 40))], "item_id long, text string"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == {*range(60), 102, 103}
    assert bpe.encoder().decode(np.array(got[102]["ids"], "<u4").tobytes()) == "mail [EMAIL] now" and got[103]["n_tokens"] == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]
