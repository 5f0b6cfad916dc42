"""Periodic runs, the conversation trie and the compression classifier on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from clauseloom.llm import periodic_runs, prefix_trie, quality, registry
from tests.llm.helpers import awkward, documents, empty

# ---------------------------------------------------------------- periodic runs


def brute_runs(words, repeats=4, least=6):
    found = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                own = words[i : i + length]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    alphabet = rng.choice([1, 2, 2, 3, 5])
    words = [rng.randrange(alphabet) for _ in range(rng.randint(0, 25))]
    for _ in range(rng.randint(0, 4)):
        period = [rng.randrange(alphabet) for _ in range(rng.randint(1, 14))]
        words += (period * rng.randint(2, 7))[: rng.randint(1, 80)]
    return words


@pytest.mark.parametrize(("repeats", "least"), [(4, 6), (3, 6), (3, 1), (5, 20), (4, 9)])
def test_runs_are_those_of_brute_force(repeats, least):
    rng = random.Random(repeats * 100 + least)
    for _ in range(300):
        docs = [periodic_words(rng) for _ in range(rng.randint(1, 4))]
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(int)
        word = np.array([w for d in docs for w in d], dtype=np.int64)
        got = periodic_runs.find_runs(word, starts, periodic_runs.Options(repeats, least))
        assert got == [(i, *r) for i, d in enumerate(docs) for r in brute_runs(d, repeats, least)], docs


def test_runs_of_long_texts_take_no_quadratic_time():
    fibonacci, longer = [0], [0, 1]
    while len(longer) < 50_000:
        fibonacci, longer = longer, longer + fibonacci
    for words, expected in (
        ([0] * 60_000, [(0, 0, 60_000, 1)]),
        (list(range(700)) * 80, [(0, 0, 56_000, 700)]),
        (longer, []),
    ):
        assert periodic_runs.find_runs(np.array(words, dtype=np.int64), np.array([0, len(words)])) == expected


def expected_row(doc_id, text):
    """The contract of the query, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest(),
    )


def test_query_of_runs_equals_brute_force(spark):
    rng = random.Random(3)
    spaces = [" ", "\n", "\t ", "\x0b", "\r\n"]
    texts = [rng.choice(["", " "]) + "".join(f"w{w}é" + rng.choice(spaces) for w in periodic_words(rng)) for _ in range(300)]
    texts += [None, "", " \n", "one", "           ", "\x1c \x1c \x1c \x1c \x1c \x1c"]
    docs = documents(spark, texts)
    got = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(docs))).collect()
    assert sorted(map(tuple, got)) == [expected_row(i, t) for i, t in enumerate(texts)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10


def test_runs_keep_whole_texts_and_spans(spark):
    text = "start " + "a b c " * 5 + "end"
    (row,) = periodic_runs.periodic_runs(documents(spark, [text])).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 15, 3)] == [tuple(row["strongest"])]
    assert row["collapsed"] == "start a b c end" and row["n_words"] == 17


def test_runs_of_awkward_rows(spark):
    rows = periodic_runs.periodic_runs(awkward(spark)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 7 and None in by
    assert by[1]["runs"] == by[2]["runs"] == [] and by[1]["strongest"] is None and by[1]["collapsed"] == ""
    assert [tuple(r) for r in by[3]["runs"]] == [(0, 30_000, 10)]
    assert by[3]["collapsed"] == "one two three four five six seven eight nine ten"
    assert periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(awkward(spark)))).count() == 7
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0


# ---------------------------------------------------------------- conversation trie

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, convs in members.items():
        own_saved = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] = saved.get(node[:d], 0) + own_saved
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
    return sorted(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children.get(node, 0), leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, sorted(c for c in convs if built[c] == node))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


def trie_rows(spark, rows, options=None):
    table = spark.createDataFrame(rows, TURNS)
    turns = prefix_trie.with_borrowed_heads(prefix_trie.ordered_turns(table))
    options = options or prefix_trie.Options()
    found = prefix_trie.prefix_trie(turns, table.where("conv_id is not null").select("conv_id"), options)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("height", [2, 3, 16])
def test_trie_equals_brute_force(spark, height):
    rng = random.Random(height)
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["yes", "né", "", None]) if turn > 1 else "hi"))
    # One long conversation, and a copy of it that ends earlier.
    rows += [(100, turn, "user", f"t{turn % 7}") for turn in range(60)]
    rows += [(110, turn, "user", f"t{turn % 7}") for turn in range(50)]
    rng.shuffle(rows)
    got = trie_rows(spark, rows, prefix_trie.Options(height=height, piece=3))
    assert got == brute_trie(rows)
    assert max(r[1] for r in got) >= 59


def test_trie_of_awkward_rows(spark):
    rows = [
        (None, 0, "user", "nobody"),
        (0, None, "user", "first, as its turn is null"),
        (0, 0, None, None),
        (0, 0, "user", "same turn"),
        (0, 0, "user", "same turn"),  # a repeated row is a turn of its own
        (3, 5, "user", "alone"),
        (3, 9, "user", "x" * 50_000),
        (8, 1, "user", "the leader 5 is absent"),
    ]
    rows += [(c, 0, "user", "hi") for c in range(20, 400)]
    assert trie_rows(spark, rows) == brute_trie(rows)
    assert trie_rows(spark, []) == []
    hot = prefix_trie.Options(hot_share=0.9)  # every node by the shuffled join
    assert trie_rows(spark, rows, hot) == brute_trie(rows)


def test_one_conversation_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 16)
    rows = [(10, turn, "user", str(turn * turn % 11)) for turn in range(300)]
    rows += [(c, turn, "user", str(turn * turn % 11)) for c in range(11, 16) for turn in range(c)]
    assert trie_rows(spark, rows, prefix_trie.Options(height=4)) == brute_trie(rows)


# ---------------------------------------------------------------- quality


def sample_texts(rng, n):
    words = ["".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts, good = [], []
    for i in range(n):
        own = rng.choices(words, k=rng.randint(20, 300))
        good.append(int(i % 5 != 0))
        texts.append(" ".join(own) if good[-1] else rng.choice(["!! ", "*** ", " | "]).join(w.upper() for w in own))
    return texts, good


def test_quality_holds_out_and_predicts(spark):
    texts, good = sample_texts(random.Random(5), 900)
    docs = documents(spark, [*texts, None, ""])
    # Labels of held-out rows are turned round: they must not be learnt.
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(902)]
    table = spark.createDataFrame([(i, g if not held[i] else 1 - g, 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, table)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    right = [got[i]["predicted"] == good[i] for i in range(900) if held[i]]
    assert sum(right) / len(right) > 0.97
    assert all(got[i]["held_out"] == held[i] and 0 <= got[i]["score"] <= 1 for i in range(902))
    assert got[900]["score"] == got[901]["score"] and got[900]["n_bytes"] == 0
    again = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(7), quality.train(docs.repartition(5), table)).collect()}
    assert all(again[i] == got[i]["score"] for i in range(902))  # whatever the layout of the rows


def test_quality_scores_the_end_of_a_long_text():
    texts, good = sample_texts(random.Random(6), 300)
    options = quality.Options()
    blocks = {g: [b for t, own in zip(texts, good, strict=True) if own == g for b in quality.cut(t.encode(), options.block)] for g in (0, 1)}
    judge = quality.Evidence(quality.trained(blocks[1], 20_000), quality.trained(blocks[0], 20_000), options)
    clean = " ".join(t for t, g in zip(texts[:150], good, strict=False) if g)
    spoilt = clean + " ".join(t for t, g in zip(texts, good, strict=True) if not g)
    first, second = (quality.evidence(np.array(judge.sizes(t)), options)[0, 0] for t in (clean, spoilt))
    assert first > second
    n, small, large = judge.sizes(clean)
    parts = [judge.sizes(clean[at : at + options.block]) for at in range(0, len(clean), options.block)]
    assert (n, small, large) == tuple(map(sum, zip(*parts, strict=True)))


def test_calibration_is_a_curve_of_the_evidence():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(0, 0.1, 4000), rng.uniform(0.2, 0.6, 4000)])
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(0.5 + 20 * x[:, 0] + 2 * x[:, 1])))).astype(float)
    weights = quality.calibrate(x, y)
    assert np.allclose(weights, (0.5, 20, 2), rtol=0.25, atol=0.4)
    assert quality.calibrate(x[:0], y[:0]) == (0.0, 0.0, 0.0)
    inverse = quality.calibrate(x, 1 - y)
    assert inverse[1] == 0.0 and abs(1 / (1 + np.exp(-inverse[0])) - (1 - y).mean()) < 0.01


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        model = quality.train(awkward(spark), table)
        rows = quality.score(awkward(spark), model).collect()
        assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
        assert not next(r for r in rows if r["doc_id"] is None)["held_out"]
        assert quality.score(empty(spark), model).count() == 0


def test_new_queries_return_the_agreed_columns(spark):
    folder = "/root/testdata/sf0.001"
    kinds = {name: dict(registry.QUERIES[name](spark, folder).dtypes) for name in ("op11_quality", "op12_periodic_runs", "op13_prefix_trie")}
    assert kinds["op11_quality"] == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert set(kinds["op12_periodic_runs"].values()) == {"bigint", "string"} == set(kinds["op13_prefix_trie"].values())
