"""Near duplicates, repeated strings, embeddings and urls against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import embedding_dedup, near_dedup, neighbours, suffix_dedup, url_reputation
from clauseloom.llm.common import components
from clauseloom.llm.suffix_sort import suffix_array
from tests.llm.helpers import awkward, documents, empty


def lowest_by_links(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, j) for j in range(101, 130)] + [(7, 7)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[j] == 100 for j in range(100, 130))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize("block", [2048, 8])
def test_near_duplicates_equal_brute_force(spark, block):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "Two words", "two WORDS", "x"]
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(30, 90))
        for _ in range(rng.choice([1, 3, 14])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    options = near_dedup.Options(words=4, block=block)
    rows = near_dedup.near_duplicates(documents(spark, texts), options).collect()
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    want = lowest_by_links(list(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r for r in rows}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in sets)


def test_near_duplicates_gather_two_blocks_at_most(spark):
    """No task gathers a bucket of many components, and each pair of them meets once."""
    rows = [(n, 7, 3, 0, 60) for n in range(60)] + [(n, 8, 3, 100, 60) for n in range(100, 160)]
    shared = spark.createDataFrame(rows, "node long, bucket long, band int, leader long, size long")
    joined = spark.createDataFrame([(n, 0) for n in range(20)], "node long, component long")
    options = near_dedup.Options(block=8)
    dealt = near_dedup._block_pairs(shared, joined, options)
    gathered = [r["count"] for r in dealt.groupBy("bucket", "i", "j").count().collect()]
    assert gathered and max(gathered) <= 40 < 60
    # Every pair of different components meets in one block pair, once.
    groups = {}
    for r in dealt.collect():
        groups.setdefault((r["bucket"], r["i"], r["j"]), []).append(r)
    met = {}
    for (_, i, j), own in groups.items():
        for a in own:
            for b in own:
                if a["node"] < b["node"] and a["component"] != b["component"] and (i == j or a["side"] != b["side"]):
                    met[a["node"], b["node"]] = met.get((a["node"], b["node"]), 0) + 1
    part = {n: 0 if n < 20 else n for n in (*range(60), *range(100, 160))}
    want = {(a, b) for a in part for b in part if a < b and part[a] != part[b] and (a < 60) == (b < 60)}
    assert set(met) == want and set(met.values()) == {1}


def test_near_duplicates_of_awkward_rows(spark):
    rows = near_dedup.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 7 and sum(r["kept"] for r in rows) == 7
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(i, i) for i in (None, 1, 2, 3, 4, 5)}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    kept = near_dedup.without_near_duplicates(awkward(spark))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5] and kept.columns == awkward(spark).columns


def test_rows_that_share_a_key_are_linked(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l"), (3, "a b c d e f"), (9, "m n o p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_posterior_bounds():
    bounds = near_dedup.needed_matches(near_dedup.Options())
    assert all(0 < least < n for n, least in bounds[1:]) and bounds[-1][0] == 128
    assert [b[1] for b in bounds] == sorted(b[1] for b in bounds)


def test_suffix_array_equals_sorting():
    rng = random.Random(3)
    for _ in range(4000):
        symbols = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 16))]
        assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    text = list(b"abracadabra " * 300)
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_removed(texts, length):
    first, out = {}, []
    for d, t in enumerate(texts):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first.setdefault(data[i : i + length], d) < d:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_repeats_equal_brute_force(spark, parts):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdé ") for _ in range(140))
    texts = [None, "", "x" * 49, "aaaa" * 40, "a" * 30 + "b" * 50, "日本" * 30]
    for _ in range(40):
        own = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 120)))
        cut = rng.randint(0, 90)
        texts.append(own + rng.choice([passage, passage[cut:], passage[: cut + 40], "a" * cut, ""]) + own[::-1])
    texts += texts[8:12] + [passage, "a" * 60]
    options = suffix_dedup.Options(parts=parts, sorted_bytes=2000, flush_bytes=3000, buckets=8)
    rows = suffix_dedup.remove_repeats(documents(spark, texts), options).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == brute_removed(texts, 50)
    one = next(r for r in rows if r["n_spans"])
    data = (texts[one["doc_id"]]).encode()
    left = b"".join(data[i : i + 1] for i in range(len(data)) if not any(s["start"] <= i < s["end"] for s in one["spans"]))
    assert bytes(one["kept"]) == left


def test_rows_of_shared_places_number_as_the_shares_of_documents():
    """Many documents that share anchors in many buckets: no row for each document and bucket."""
    options = suffix_dedup.Options(doc_buckets=16)
    docs = np.array([-(1 << 63), *range(-500, 2499)], np.int64)
    rows = []
    for bucket in range(8):
        # An anchor in all documents, and another that the documents of one task are known to share.
        h, flag = np.full(len(docs), bucket + 1, np.uint64), np.zeros(len(docs), np.uint8)
        asked = suffix_dedup._packed(docs, np.full(len(docs), 70_000 + bucket), h, flag)
        known = suffix_dedup._packed(docs[::2], np.full(len(docs[::2]), bucket))
        batch = pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "asked": [asked], "known": [known]})
        rows += [r for out in suffix_dedup._shared_places(iter([batch]), options) for r in out.to_pylist()]
    assert len(rows) <= 8 * options.doc_buckets
    rows.sort(key=lambda r: r["share"])
    dealt = pa.RecordBatch.from_pydict({"share": pa.array([r["share"] for r in rows], pa.int32()), "packed": [r["packed"] for r in rows]})
    cut = [dealt.slice(at, 7) for at in range(0, dealt.num_rows, 7)]
    got = [r for out in suffix_dedup._by_document(iter(cut)) for r in out.to_pylist()]
    far = list(range(70_000, 70_008))
    assert sorted((r["doc"], r["places"]) for r in got) == [(d, list(range(8)) * (i % 2 == 0) + far) for i, d in enumerate(docs.tolist())]


def test_bytes_common_to_a_group_are_one_symbol(monkeypatch):
    """Parts of 58 bytes around one anchor, 42 of them in common: 17 symbols and an end are sorted, not 59."""
    seen = []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda symbols: seen.append(len(symbols)) or suffix_array(symbols))
    options = suffix_dedup.Options()
    rng = random.Random(4)
    core, ends = bytes(rng.choices(range(97, 123), k=42)), [bytes(rng.choices(b"xy", k=8)) for _ in range(12)]
    sorter = suffix_dedup._Sorter(options)
    symbol, other = sorter.group(), sorter.group()
    pieces = [(left + core + right, doc) for doc, (left, right) in enumerate((a, b) for a in ends for b in ends)]
    lows = [sorter.add(piece, doc, symbol, 8, 50) for piece, doc in pieces]
    alone = sorter.add(pieces[0][0], 999, other, 8, 50)
    sorter.finish()
    assert seen == [18 * (len(pieces) + 1)] and alone == [999] * 9
    first = {}
    for piece, doc in pieces:
        for i in range(9):
            first.setdefault(piece[i : i + 50], doc)
    assert lows == [[first[piece[i : i + 50]] for i in range(9)] for piece, _ in pieces]


def test_repeats_of_awkward_rows(spark):
    rows = suffix_dedup.remove_repeats(awkward(spark)).collect()
    assert len(rows) == 7 and all(r["n_removed"] == 0 for r in rows)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    text = "a sentence that is longer than fifty bytes, and then some more of it"
    docs = spark.createDataFrame([(4, text), (4, text + "x"), (None, text), (7, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(0, 0), (4, 0), (4, 0), (7, len(text))]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def cloud(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1])
            vector = base * rng.uniform(0.1, 5) + rng.normal(0, 0.04, dim) * np.linalg.norm(base) * rng.integers(0, 2)
        else:
            vector = rng.normal(size=dim)
        rows.append((i, vector.tolist(), int(rng.integers(0, 2))))
    return rows


ODD = [
    (900, None, 1), (901, [0.0] * 12, 1), (902, [float("nan")] + [1.0] * 11, 1), (903, [None] + [1.0] * 11, 1),
    (904, [1.0] * 12, None), (905, [float("inf")] + [1.0] * 11, 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [], 0),
]


@pytest.mark.parametrize("block", [1024, 4])
def test_embedding_links_equal_brute_force(spark, block):
    rows = cloud(1, 240) + [(300 + i, [1.0] * 12, 1) for i in range(20)]
    got = embedding_dedup.near_duplicates(vectors(spark, rows + ODD), embedding_dedup.Options(block=block)).collect()
    by = {r["vec_id"]: r for r in got}
    units = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: c for i, _, c in rows}

    def linked(a, b):
        return label[a] == label[b] and units[a] @ units[b] >= 0.98

    want = lowest_by_links(list(units), linked)
    assert {i: by[i]["component_id"] for i in units} == want
    assert all(by[i]["n_links"] == sum(linked(i, j) for j in units if j != i) for i in units)
    assert all((by[i]["n_links"], by[i]["kept"]) == (0, True) for i, _, _ in ODD if i not in (906, 907))
    assert by[907]["component_id"] == 906 and by[906]["n_links"] == 1
    assert len(got) == len(rows) + len(ODD)


def test_embedding_links_of_odd_tables(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0
    twice = vectors(spark, [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]).withColumn("node", F.lit(1))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(twice).collect()]
    assert sorted(got, key=str) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


@pytest.mark.parametrize("block", [32_768, 60])
def test_neighbours_recall(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(400)] + [(500 + i, [1.0] * 16, 0) for i in range(8)]
    options = neighbours.Options(block=block, query_block=7)
    got = neighbours.nearest(vectors(spark, rows + ODD), F.col("vec_id") % 20 == 0, options).collect()
    ids = np.array([r[0] for r in rows])
    units = np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in rows])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = units @ units[ids == q][0]
        scores[ids == q] = -9
        order = np.lexsort((ids, -np.round(scores, 12)))[:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        hits += len({r[1] for r in own} & set(ids[order].tolist()))
        total += 5
        by = dict(zip(ids.tolist(), scores, strict=True))
        assert all(abs(by[v] - s) < 1e-12 for _, v, s in own)
    assert hits / total >= 0.97


def test_neighbours_order_ties_by_id(spark):
    """Copies and multiples of one vector are ties, whatever the blocks and the order of the rows."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=64)
    rows = [(i, (base * (1.0 if i % 2 else rng.uniform(0.1, 9))).tolist(), 0) for i in range(1, 60)]
    rows += [(100 + i, rng.normal(size=64).tolist(), 0) for i in range(60)]
    for block in (7, 40, 32_768):
        rng.shuffle(rows)
        got = neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, neighbours.Options(block=block)).collect()
        for q in (20, 40):
            own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
            assert own == [(i, i) for i in range(1, 6)], (block, q, own)


def test_neighbours_count_each_query_about_once(monkeypatch):
    """The search ends at the same radius as one that widens step by step, without a count for every step."""
    rng = np.random.default_rng(6)
    options = neighbours.Options(directions=40)
    counted, count = [], neighbours.Index._collisions
    monkeypatch.setattr(neighbours.Index, "_collisions", lambda *own: counted.append(1) or count(*own))
    monkeypatch.setattr(neighbours, "PART", 64)
    vectors = rng.normal(size=(300, 24))
    vectors[200:230] = vectors[:30] * rng.uniform(0.1, 9, (30, 1))
    vectors[230:260] = vectors[:30] + rng.normal(scale=0.1, size=(30, 24))
    vectors[260:300] = vectors[0] + rng.normal(scale=0.03, size=(40, 24))
    ids = rng.permutation(300)
    index = neighbours.Index(ids, vectors, options)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    lines = units @ index.directions
    for q, found, scores in index.search(ids, vectors):
        cosines = np.round((units * units[q]).sum(axis=1), 12)
        for radius in index._radii():
            met = np.flatnonzero((np.abs(lines - lines[q]) <= options.width * radius / 2).sum(axis=1) >= index.least)
            met = met[met != q]
            best = met[np.lexsort((ids[met], -cosines[met]))][:5]
            if len(best) == 5 and 2 - 2 * cosines[best[-1]] <= radius**2:
                break
        assert found.tolist() == ids[best].tolist()
        assert np.abs(scores - cosines[best]).max() < 1e-11
    assert len(counted) < 2 * 300


def test_neighbours_of_odd_tables(spark):
    assert neighbours.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    few = vectors(spark, [(20, [1.0, 0.0], 0), (1, [0.0, -1.0], 0), (2, [0.0, 2.0], 0), (3, [-1.0, 0.0], 0), *ODD[:4]])
    got = neighbours.nearest(few, F.col("vec_id") == 20).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, -1.0)]


def test_urls_by_rule_and_reputation(spark):
    urls = [
        None, "no scheme", "http://EXAMPLE.com/en/x?q#f", "http://www.example.com/en/", "http://a.b.net/fr/1", "https://x.org",
        "http://bad.org/p", "http://notcom/", "http://sub.bad.org/q", "ftp://h.com?x/y", "http://fresh.bad.org/z", "://K.com/",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, "http://bad.org/p") for i in range(60)]
    rows += [(200 + i, "http://good.org/p") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = [(100 + i, True) for i in range(60)] + [(200 + i, False) for i in range(60)] + [(None, True), (5, None)]
    outcomes = spark.createDataFrame(labels, "page_id long, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge(pages, outcomes).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[4] == ("a.b.net", "/fr/1", "net/fr/", "block")
    assert got[5] == ("x.org", "", None, "allow") and got[6][3] == "block" and got[200][3] == "allow"
    assert got[7] == ("notcom", "/", None, "allow") and got[9] == ("h.com", "", None, "allow")
    assert got[10][3] == "block"  # a new host of a bad domain
    assert got[11] == ("k.com", "/", "com/", "allow")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert {r["verdict"] for r in url_reputation.judge(pages.where("page_id < 2"), none).collect()} == {"allow"}
    assert url_reputation.judge(pages.limit(0), outcomes).count() == 0


def test_reputation_shrinks_to_domain_suffix_and_all_pages(spark):
    """Three levels against the same formulas worked out one host at a time."""
    counts = {  # host: labelled pages, bad ones
        "a.bad.org": (40, 30), "b.bad.org": (30, 24), "c.bad.org": (1, 1), "x.good.org": (60, 3), "y.good.org": (50, 1),
        "z.good.org": (1, 1), "one.fine.com": (80, 4), "two.fine.com": (90, 5),
    }
    rows = [(host, at < bad) for host, (n, bad) in counts.items() for at in range(n)]
    pages = [(i, f"http://{host}/p") for i, (host, _) in enumerate(rows)]
    pages += [(9001, "http://new.bad.org/"), (9002, "http://new.org/"), (9003, "http://new.xyz/"), (9004, "http://z.good.org/q")]
    pages += [(9004, "http://z.good.org/q"), (None, "http://a.bad.org/")]
    outcomes = [(i, bad) for i, (_, bad) in enumerate(rows)]
    judged = url_reputation.judge(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad boolean")
    ).collect()

    z, total, ills = 1.645, sum(n for n, _ in counts.values()), sum(bad for _, bad in counts.values())

    def posterior(alpha, beta):
        size = alpha + beta
        return alpha / size, alpha / size - z * (alpha * beta / (size * size * (size + 1))) ** 0.5

    def level(names, mean):
        tally = {}
        for host, (n, bad) in counts.items():
            name = names(host)
            had = tally.get(name, (0, 0, mean(host)))
            tally[name] = (had[0] + n, had[1] + bad, had[2])
        spread = sum(n * (bad / n - m) ** 2 - m * (1 - m) for n, bad, m in tally.values())
        weight = sum(m * (1 - m) * (n - 1) for n, _, m in tally.values())
        rho = spread / weight
        strength = max(2.0, min(1000.0, 1 / rho - 1 if rho > 0 else 1000.0))
        return {name: posterior(strength * m + bad, strength * (1 - m) + n - bad) for name, (n, bad, m) in tally.items()}

    rate, bound = posterior(ills + 1, total - ills + 1)
    suffix = level(lambda h: h.split(".")[-1], lambda h: rate)
    domain = level(lambda h: ".".join(h.split(".")[-2:]), lambda h: suffix[h.split(".")[-1]][0])
    host = level(lambda h: h, lambda h: domain[".".join(h.split(".")[-2:])][0])
    want = {name: lower for name, (_, lower) in host.items()}
    want |= {"new.bad.org": domain["bad.org"][1], "new.org": suffix["org"][1], "new.xyz": bound}
    for row in judged:
        assert abs(row["reputation"] - want[row["host"]]) < 1e-9
        if row["rule"] is None:
            assert row["verdict"] == ("block" if row["reputation"] > min(0.5, 1.25 * rate) else "allow")
    verdicts = {r["host"]: r["verdict"] for r in judged}
    # One bad page of one condemns a host below a bad domain; below a good one it is shrunk away.
    assert verdicts["c.bad.org"] == verdicts["a.bad.org"] == verdicts["new.bad.org"] == "block"
    assert verdicts["z.good.org"] == verdicts["x.good.org"] == "allow"
    assert len(judged) == len(pages) and sum(r["page_id"] == 9004 for r in judged) == 2
