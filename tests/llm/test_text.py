"""Operators on documents against brute force, with odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netquarry.llm import bpe, components, decontaminate, jaccard, pii, simhash, token_files, toxicity
from netquarry.llm.common import removed, settled
from netquarry.llm.runs import Runs

from .data import ODD, WORDS, frame, tables, text


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


# SimHash


def brute_fingerprint(t):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if shingles and 2 * ones[b] > len(shingles))


def test_fingerprints():
    for _, t in ODD:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    assert simhash.fingerprint("A b C\x0bd") == simhash.fingerprint("a b c d") != simhash.fingerprint("À b c d")


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        other = words.copy()
        for i in range(len(other)):
            for b in rng.choice(23, flips, replace=False):
                other[i] ^= 1 << b
        keys = [{}, {}]
        for k, w in enumerate((words, other)):
            for r, key in zip(*simhash.golay_keys(w), strict=True):
                keys[k].setdefault(int(r), set()).add(int(key))
        assert all(keys[0][i] & keys[1][i] for i in range(len(words)))
        assert {len(s) for s in keys[0].values()} <= {1, 6}


def fingerprints(n, seed):
    """Chains, a crowd around one centre, pairs at distances 1 to 4 and strangers."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    flipped = lambda f, k: f ^ sum(1 << b for b in rng.sample(range(64), k))
    out += [flipped(f, k) for f in out[:40] for k in (1, 2, 3, 4)]
    for _ in range(30):
        out.append(flipped(out[-1], 2))
    centre = out[0]
    out += [centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12, 24)]
    return sorted({f - (1 << 64) if f >> 63 else f for f in out})


def test_links_give_all_components(spark):
    fps = fingerprints(200, 3)
    bits = np.array(fps, np.int64).view(np.uint64)
    edges = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.nonzero(np.bitwise_count(bits ^ bits[i]) <= 2)[0] if j > i]
    want = union_find(fps, edges)
    got = components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    mine = {r["node"]: r["root"] for r in got}
    assert set(mine) == {n for e in edges for n in e}
    groups = lambda d: sorted(sorted(n for n in mine if d[n] == r) for r in {d[n] for n in mine})
    assert groups(mine) == groups(want)


def test_components_of_odd_graphs(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert components.components(edges([])).count() == 0
    assert components.components(edges([(1, 1), (None, 2), (2, None)])).count() == 0
    path = [(i, i + 1) for i in range(200)] + [(1, 0), (1, 0)] + [(1000, x) for x in range(2000, 2100)]
    roots = {r["node"]: r["root"] for r in components.components(edges(path)).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and len(set(roots.values())) == 2


def test_components_of_few_edges_take_few_jobs(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long")
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        got = components.components(path).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(got) == 3001 and len({r["root"] for r in got}) == 1
    assert len(jobs) <= 10  # the driver keeps what it knows of each


@pytest.mark.parametrize("few", [0, 40, 1 << 14])
def test_components_are_exact_whatever_one_task_joins(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    dice = random.Random(5)
    pairs = [(dice.randrange(-400, 400), dice.randrange(-400, 400)) for _ in range(380)] + [(1 << 62, -(1 << 63)), (7, 7), (None, 8)]
    root = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}
    for a, b in (p for p in pairs if None not in p and p[0] != p[1]):
        old, new = root[a], root[b]
        root = {k: new if v == old else v for k, v in root.items()}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got.keys() == root.keys() and all(got[r] == r for r in got.values())
    assert len(set(got.values())) == len(set(root.values())) == len({(got[x], root[x]) for x in root})


def test_driver_gives_back_memory(spark):
    big = spark.sparkContext.broadcast(bytes(1))
    settled(spark)
    assert big.value == bytes(1)  # what is in use stays


def test_near_duplicates_of_odd_rows(spark):
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame(spark)).collect()), key=str)
    assert len(got) == len(ODD)
    d = dict(got)
    assert d[1] == d[2] == 1 and d[5] == d[6] == d[7] == 5 and d[8] == 8 and d[10] == 10
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.keep_one(spark, frame(spark), "")
    assert kept.columns == frame(spark).columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(1) == 1 and 2 not in ids and 6 not in ids and 4 in ids


def test_keep_one_decides_by_row(spark):
    rows = [(None, text(40, 21)), (None, text(40, 22)), (7, text(40, 23)), (7, text(40, 24)), (3, text(40, 24)), (None, text(40, 24)), (8, text(40, 25)), (8, text(40, 25))]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(spark, frame(spark, rows), "").collect()), key=str)
    assert kept == sorted([(None, text(40, 21)), (None, text(40, 22)), (7, text(40, 23)), (3, text(40, 24)), (8, text(40, 25))], key=str)


def test_near_copies_go(spark):
    """Against brute force: variants of some texts, a crowd around one, texts that share a line."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(words) for _ in range(20))
    docs = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice((1, 3, 5, 40))):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 40)):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((len(docs), " ".join(own) + (" " + line if rng.random() < 0.3 else "")))
    rng.shuffle(docs)
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}) for i, t in docs]
    edges = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[k + 1 :] if 5 * len(x & y) >= 4 * len(x | y)]
    roots = union_find([i for i, _ in docs], edges)
    least = {}
    for i, r in roots.items():
        least[r] = min(i, least.get(r, i))
    kept = sorted(r["doc_id"] for r in simhash.keep_one(spark, frame(spark, docs), "").collect())
    assert kept == sorted(least.values()) and len(kept) < len(docs) // 2


# Byte-pair encoding


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def strings(n):
    rng = random.Random(7)
    letters = "abcdeéèßñ 012 \n\t.,'!<|>字😀\x1c\x1d\x85\xa0 ​́ªʰstheing"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [
        "", " ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", " \n<|endoftext|>\n\n x", "a" * 3000, "ab" * 500, "the" * 300, " " * 500, "don't we'll  I'm",
    ]


def test_encoding_is_exact(library):
    mine, files = bpe.encoder(), token_files.library()
    for s in strings(3000):
        want = library.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(s), "<u4").tolist() == want, s
        assert np.frombuffer(files.encode(s), "<u4").tolist() == want, s
        assert mine.decode(mine.encode(s)) == library.decode(want, skip_special_tokens=False) == s
    assert mine.encode(None) == files.encode(None) == b""


def test_encoding_forgets(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    mine, files = bpe.Encoder(bpe.VOCABULARY), token_files.Library(token_files.VOCABULARY)
    for s in strings(100):
        want = library.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(s), "<u4").tolist() == np.frombuffer(files.encode(s), "<u4").tolist() == want


def test_round_trip_query(spark, tmp_path, library):
    d = tables(spark, tmp_path, documents=frame(spark))
    got = sorted((tuple(r) for r in bpe.op3_bpe(spark, d).collect()), key=str)
    want = []
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    again = bpe.decoded(bpe.encoded(frame(spark)))
    assert sorted((tuple(r) for r in again.collect()), key=str) == sorted(((i, t or "") for i, t in ODD), key=str)
    assert bpe.encoded(frame(spark, [])).count() == 0


# Token files


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, u in ((0, 1), (1, 1), (5, 5), (1000, 10**6), (3000, 3000), (700, 100), (1000, 2**62)):
        v = np.sort(rng.integers(0, u, n))
        e = token_files.EliasFano.of(v)
        assert (e.values() == v).all() and all(e.select(i) == v[i] for i in range(n))
        if n > 500:
            assert len(e.tobytes()) * 8 / n <= 2.5 + np.log2(max(1, u / n)) + 0.5
        again, end = token_files.EliasFano.read(b"x" + e.tobytes(), 1, e.sizes())
        assert end == 1 + len(e.tobytes()) and (again.values() == v).all()


def test_token_files(spark, tmp_path, library):
    docs = frame(spark).repartition(3)
    token_files.write(docs, f"file://{tmp_path}/t")
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(spark, f"file://{tmp_path}/t").collect()))
    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for (i, t), r in zip(order, got, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, token_files.END]
        assert r == (start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    raw = next((tmp_path / "t").glob("*.ids")).read_bytes()
    shard = token_files.Shard(raw)
    assert all(shard.document(i)[-1] == token_files.END for i in range(shard.boundaries.n))
    with pytest.raises(ValueError, match="cut short"):
        token_files.Shard(raw[:-1])
    token_files.write(frame(spark, []), f"file://{tmp_path}/none")
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            total = sum((int(x) * 2 - 9 if int(x) > 4 else int(x) * 2) if i % 2 else int(x) for i, x in enumerate(d[::-1]))
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}
            if good[kind]:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda x: (x[0], list(BASE).index(x[2])))


def test_base_spans():
    rng = random.Random(5)
    for n in range(20000):
        t = "".join(rng.choice("a.@-+1289 () %éZ"[: 8 + n % 9]) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t), t
    for t in ("4111 1111 1111 1111", "4111-1111-1111-1111 +1 (555) 010-9999", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "x" * 5000 + "@y.z", "1" * 5000, "@" * 3000):
        assert pii.base_spans(t) == brute_spans(t)


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"please call +1 555 010 {1000 + i} now") for i in range(20)]
    unseen = [(100, "please call 555010777 now"), (101, "we saw 555010778 there"), (102, None), (103, ""), (103, "")]
    got = {r["doc_id"]: r["pii_spans"] for r in pii.find(frame(spark, seeds + unseen)).collect()}
    assert [(s["start"], s["end"], s["kind"]) for s in got[100]] == [(12, 21, "phone")]
    assert got[101] == [] and got[102] == [] and len(got[0]) == 1
    assert pii.find(frame(spark, [])).count() == 0
    masked = {r["doc_id"]: r for r in pii.mask(spark, frame(spark, seeds + unseen), "").collect()}
    assert masked[100]["text"] == "please call [PHONE] now" and masked[100]["n_chars"] == 23 and masked[101]["text"] == unseen[1][1] and masked[102]["text"] is None


def test_contexts_find_unseen_addresses(spark):
    seeds = [(i, f"contact mail: user{i}@example.com today") for i in range(40)]
    odd = ["jane.doe@intranet", "jane(at)example.com", "jane.doe at example dot com", "jane [at] example [dot] com"]
    unseen = [(100 + i, f"contact mail: {x} today") for i, x in enumerate(odd)] + [(200, "we met at noon"), (201, "see jane.doe@intranet there")]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(spark, frame(spark, seeds + unseen), "").collect()}
    assert all(masked[100 + i] == "contact mail: [EMAIL] today" for i in range(len(odd)))
    assert masked[200] == "we met at noon" and masked[201] == unseen[-1][1] and masked[0] == "contact mail: [EMAIL] today"


def test_contexts_find_short_numbers(spark):
    rows = [(i, f"please call +1 555 010 {1000 + i} now") for i in range(20)] + [(100, "please call 5550 now"), (101, "in 1999 then")]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(spark, frame(spark, rows), "").collect()}
    assert masked[100] == "please call [PHONE] now" and masked[101] == "in 1999 then"


# Toxicity


def test_toxicity_learns_rare_expressions(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(1500):
        ws = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            ws.insert(rng.randint(0, len(ws)), f"vile{rng.randint(0, 9)}")
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    ds, ls = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(ds, ls)
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(ds, model).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == labels[i][1] for i in held]) > 0.97
    odd = toxicity.score(frame(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["toxic_score"] <= 1 for r in odd)
    # what held-out documents are labelled makes no difference
    flipped = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, y in labels], "doc_id long, toxic int")
    again = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(ds, toxicity.fit(ds, flipped)).collect()}
    assert again == pytest.approx(got)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = [r["toxic_score"] for r in toxicity.score(frame(spark), toxicity.fit(frame(spark), none)).collect()]
    assert scores == pytest.approx([0.001] * len(ODD))
    assert toxicity.score(frame(spark, []), toxicity.fit(frame(spark, []), none)).count() == 0


def test_kneser_ney_against_brute_force(spark):
    """All counts are used, and each context's probabilities add up to 1 over the vocabulary and one unknown word."""
    rng = random.Random(4)
    texts = [(" ".join(rng.choices("a b c d e f g rare".split(), [9, 8, 6, 4, 3, 2, 1, 0.3], k=rng.randint(1, 12))), rng.randint(0, 1)) for _ in range(60)]
    model = toxicity.count(spark.createDataFrame(texts, "text string, toxic int").repartition(3))
    known = toxicity.lexicon(model)
    pairs = [{}, {}]
    for t, y in texts:
        got = ["", *t.split()]
        for x in zip(got, got[1:]):
            pairs[y][x] = pairs[y].get(x, 0) + 1
    every = pairs[0].keys() | pairs[1].keys()
    vocabulary = sorted({b for _, b in every})
    assert model.vocabulary == len(vocabulary)

    def spread(counts):
        d = toxicity.discounts({k: sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)})
        return {b: (n - d[min(n, 3)]) / sum(counts.values()) for b, n in counts.items()}

    both = spread({b: sum(x[1] == b for x in every) for b in vocabulary})
    shared = lambda b: both.get(b, 0) + (1 - sum(both.values())) / (len(vocabulary) + 1)
    for c in (0, 1):
        own = spread({b: n for b in vocabulary if (n := sum(x[1] == b for x in pairs[c]))})
        low = lambda b: own.get(b, 0) + (1 - sum(own.values())) * shared(b)  # noqa: B023, E731
        d = toxicity.discounts({k: sum(n == k for n in pairs[c].values()) for k in (1, 2, 3, 4)})
        for a in ["", *vocabulary, "never seen"]:
            after = {b: n for (x, b), n in pairs[c].items() if x == a}
            whole, left = sum(after.values()), sum(d[min(n, 3)] for n in after.values())
            want, got = [], []
            for b in [*vocabulary, "unknown"]:
                n = after.get(b, 0)
                want.append((n - d[min(n, 3)]) / whole + left / whole * low(b) if whole else low(b))
                at = [known.find(np.array([toxicity.hashed(w)], np.uint64)) for w in (a, b)]
                seen = np.zeros((2, 1), np.int64)
                toxicity.page_pairs(model, 0).count(toxicity.mixed(*(np.array([toxicity.hashed(w)], np.uint64) for w in (a, b))), seen)
                got.append(known.probability(c, seen[c], *at, model.pair_discounts[c])[0])
            assert got == pytest.approx(want) and sum(got) == pytest.approx(1)


def test_pages_of_pairs_make_no_difference(spark, monkeypatch):
    texts = spark.createDataFrame([(text(30, i), i % 2) for i in range(80)], "text string, toxic int")
    one = toxicity.count(texts)
    monkeypatch.setattr(toxicity, "PAGE", 50)
    many = toxicity.count(texts)
    asked = [r["text"] for r in texts.collect()] + [None, "", "unknown words"]
    assert many.pages > one.pages == 1 and one.features(asked) == pytest.approx(many.features(asked))


def test_scoring_reads_no_pages_of_pairs(spark, tmp_path, monkeypatch):
    frame(spark, [*ODD, *((100 + i, text(30, i)) for i in range(120))]).repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    labels = docs.where("doc_id IS NOT NULL").selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    scores = lambda df: np.array(sorted((r["doc_id"] or 0, r["toxic_score"]) for r in df.collect()))
    whole = scores(toxicity.score(docs, toxicity.fit(docs, labels)))
    monkeypatch.setattr(toxicity, "TEXT", 1 << 10)  # many slices
    monkeypatch.setattr(toxicity, "PAGE", 200)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    removed(spark, f"{model.path}/pairs")
    assert model.pages > 2 and scores(scored) == pytest.approx(whole)


def test_lines_of_many_texts_make_no_pairs_however_many_texts(spark, monkeypatch):
    rng, made, pairs = random.Random(5), [], jaccard._pairs
    lines = [" ".join(f"line{k}word{i}" for i in range(9)) for k in range(20)]
    texts = [" ".join([*(f"own{rng.random()}" for _ in range(32)), lines[i % 20]]) for i in range(1600)]
    monkeypatch.setattr(jaccard, "SAMPLE", 50)
    monkeypatch.setattr(jaccard, "_pairs", lambda rows, other: made.append(rows.count()) or pairs(rows, other))
    named = [(int(np.uint64(jaccard.name(jaccard.words(t))).view(np.int64)), t) for t in texts]
    none = spark.createDataFrame([], "a long, b long")
    assert jaccard.groups(spark.createDataFrame(named, "node long, text string"), none).count() == 0
    assert sum(made) < 200, made


def test_ids_of_many_runs_are_put_together_in_little_memory():
    own = Runs(lambda t: b"", lambda runs: [r.encode().ljust(4) for r in runs], [], 1000)
    texts = pa.array([" ".join(["a", "bc", "d"] * 1000)] * 200)
    tracemalloc.start()
    ids, ends = own.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ends.tolist() == list(range(2999, 600_000, 2999)) and ids.tobytes()[:12] == b"bc  d   a   "
    assert peak < 28 * len(ids)


# Decontamination


def brute_contaminations(docs, items):
    out = set()
    for item_id, item in items:
        whole = decontaminate.shingles(decontaminate.words(item))
        size = len(next(iter(whole))) if whole else 0
        for doc_id, t in docs:
            got = decontaminate.words(t)
            mine = {tuple(got[i : i + size]) for i in range(len(got) - size + 1)}
            if whole and len(whole & mine) >= 0.8 * len(whole):
                out.add((doc_id, item_id, len(whole), len(whole & mine)))
    return out


@pytest.mark.parametrize("at_once", [1000, 3])
def test_decontamination(spark, at_once):
    items = [(i, text(n, 50 + i)) for i, n in enumerate((1, 3, 5, 14, 30, 59, 64, 65, 130, 300))] + [(20, None), (21, ""), (22, text(30, 54)), (3, text(14, 53))]
    docs = [(i, text(200, 200 + i) + " " + (t or "").upper() + ", " + text(90, 300 + i)) for i, t in items if i < 20]
    docs += [(500 + i, " ".join((t or "").split()[: int(len((t or "").split()) * share)])) for i, t in items for share in (0.85, 0.7)] + ODD
    found = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), at_once)
    got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in found.collect()}
    want = {}
    for d, i, n, s in brute_contaminations(docs, items):
        want[d, i] = max(want.get((d, i), (0, 0)), (s, n))
    assert got == {(d, i, n, s) for (d, i), (s, n) in want.items()}
    assert len(got) >= 10


def test_parts_far_apart_are_found():
    rng = random.Random(4)
    prose = lambda n, kind: [f"{kind}{rng.randint(0, 400)}" for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(40, 64), "w"))) for i in range(60)]
    index, docs = decontaminate.build(items), []
    for i, t in items:
        got = t.split()
        a, b = len(got) // 3, 2 * len(got) // 3
        # a shingle's reach of each part is repeated, so that all shingles but none of the whole's order stay
        docs.append((i, " ".join([*got[: a + 4], *prose(400, "x"), *got[a : b + 4], *prose(400, "y"), *got[b:]])))
        docs.append((1000 + i, " ".join(rng.choice([*got, "w1", "w2"]) for _ in range(300))))
    want = brute_contaminations(docs, items)
    assert {(d, x[0], x[1], x[2]) for d, t in docs for x in index.contaminations(t)} == want and len(want) >= 60


def test_no_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark), none).count() == 0
    assert decontaminate.contaminated(frame(spark, []), none).count() == 0


def test_block_bounds_lose_nothing():
    items = [(i, text(10 + i % 50, i)) for i in range(200)]
    index = decontaminate.build(items)
    for seed in range(30):
        terms = {index.terms[w] for w in decontaminate.words(text(60, seed)) if w in index.terms}
        passage = np.array(sorted(terms), np.int64)
        score = np.zeros(len(index.item_of))
        for t in terms:
            for at in range(index.starts[t], index.starts[t + 1]):
                score[index.units[at]] += index.impacts[at]
        assert index.search(passage).tolist() == np.nonzero(score >= decontaminate.THRESHOLD - 1e-9)[0].tolist()


def test_questions_and_answers():
    assert decontaminate.parts("What is it?\nIt is nine.") == ("What is it?", "It is nine.")
    assert decontaminate.parts("no parts") == ("no parts", "")


def test_extra_columns_pass(spark):
    odd = frame(spark).withColumn("fp", F.lit(1)).withColumn("node", F.lit(2)).withColumn("toxic", F.lit(3)).withColumn("item_id", F.lit(4)).withColumn("best", F.lit(5)).withColumn("toxic_score", F.lit(6)).withColumn("pii_row", F.lit(7))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(odd.drop("toxic_score"), toxicity.fit(odd, none)).count() == len(ODD)
    assert simhash.near_duplicates(odd).count() == len(ODD)
    assert simhash.keep_one(spark, odd, "").columns == odd.columns
    assert pii.mask(spark, odd, "").columns == odd.columns
    assert bpe.encoded(odd).count() == len(ODD)


def test_first_stage_with_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = frame(spark).withColumn("toxic_score", F.lit(6))
    kept = toxicity.drop_toxic(spark, odd, tables(spark, tmp_path, labels=none))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_drop_contaminated_decides_by_row(spark, tmp_path):
    item = text(40, 5)
    d = tables(spark, tmp_path, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = [(None, item), (3, "a clean text of a few words"), (3, "x " + item + " y"), (None, "another clean text"), (4, None), (4, "")]
    kept = decontaminate.drop_contaminated(spark, frame(spark, rows), d).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([rows[1], *rows[3:]], key=str)
