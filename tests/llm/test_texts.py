"""Token counts, secrets, packing, toxicity and mixing on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clauseloom.llm import mixing, packing, secrets, token_counts, toxicity
from tests.llm.helpers import awkward, documents, empty

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_pre_tokens_count_like_whole_texts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = token_counts.PieceCounter(PIECES)
    rng = random.Random(1)
    symbols = list("ab  \n\t▁é日.\0　") + ["<s>", "</s>", "the", "ing "]
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert counter.count(texts) == [len(model.encode(t)) for t in texts]


def test_token_counts_of_awkward_rows(spark):
    rows = token_counts.count_tokens(awkward(spark), PIECES, limit=100).collect()
    assert len(rows) == 7
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["n_bytes"], by[1]["n_tokens"]) == (0, 0) and by[2]["n_tokens"] == 0
    assert by[3]["over_limit"] and not by[5]["over_limit"] and None in by
    assert token_counts.count_tokens(empty(spark), PIECES).count() == 0


BASE = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?i:passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def brute_spans(text):
    found = []
    for number, (_, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), m.end(), number) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_automaton_finds_what_the_expressions_find(monkeypatch):
    monkeypatch.setattr(secrets, "CHUNK", 32)  # lanes and blocks of any size give the same states
    monkeypatch.setattr(secrets, "BLOCK", 256)
    scanner = secrets.Scanner()
    rng = random.Random(2)
    parts = ["token", "Secret", "api_key", "APIKEY", "password", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJ1234",
             "0123456789abcdef", "a", "é", "日", "\n", "xyz", "abcdefghijkl", "-", ".", "deadbeef"]
    for _ in range(1500):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))), None, ""]
        got = [[s for s in spans if s[2] < 3] for spans in scanner.scan(texts)]
        assert got == [brute_spans(t) for t in texts], texts


def test_added_rules_and_redaction():
    key = "-----BEGIN RSA PRIVATE KEY-----"
    text = f"x ghp_{'A1' * 20} y {key} token: short z secret=abcdefghijklmnop"
    (spans,) = secrets.Scanner().scan([text])
    kinds = [secrets.RULES[r].kind for _, _, r in spans]
    assert kinds == ["github", "private", "assign"]
    assert secrets.redacted(text, spans) == "x [github] y [private] token: short z [assign]"


def test_private_keys_go_whole():
    body = "\n".join("MIIEpAIBAAKCAQEA" + "xYz09+/" * 6 for _ in range(3))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    scanner = secrets.Scanner()
    for text, kept in (
        (f"a {begin}\n{body}\n{end} b", "a [private] b"),
        (f"a {begin}\n{body}\n and words go on", "a [private]\n and words go on"),  # no closing line
        (f"{begin}\n{body}\n{begin}\n{body}\n{end}é", "[private]\n[private]é"),
        (f"{begin} and nothing", "[private] and nothing"),
    ):
        (spans,) = scanner.scan([text])
        assert secrets.redacted(text, spans) == kept
    many = scanner.scan([f"{begin} " * 20_000])[0]
    assert len(many) == 20_000


def test_minimised_automaton_is_small_and_right():
    tree = secrets.parse("(ab|cb)+")
    automaton = secrets.compiled([tree], anywhere=False)
    state = 0
    for byte in b"abcb":
        state = automaton.following[state, byte]
    assert automaton.accepts[state] and len(automaton.following) == 4


def test_secrets_of_awkward_rows(spark):
    rows = secrets.find_secrets(awkward(spark)).collect()
    assert len(rows) == 7 and all(r["spans"] == "" for r in rows)
    assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.find_secrets(empty(spark)).count() == 0
    docs = documents(spark, ["my password = 'abcdefghijkl' ok", None])
    kept = {r["doc_id"]: r for r in secrets.without_secrets(docs).collect()}
    assert kept[0]["text"] == "my [assign]' ok" and kept[0]["n_chars"] == 15 and kept[1]["text"] is None


def test_word_encoder_equals_whole_texts():
    encoder, tokenizer = packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(1)
    symbols = list("ab  \n\t é日İΣσ.,'!̸́= K\x1c\x85 'sT1½|<") + ["<|endoftext|>", "<|startoftext|>", "'ve", "the", "A", "É"]
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_combinations_fill_the_window():
    columns = packing.combinations(12)
    assert (columns.sum(axis=1) == 12).all() and len(np.unique(columns, axis=0)) == len(columns) == 6 + 12


@pytest.mark.parametrize("texts", [["word " * n for n in range(1, 60)] + [None, ""], ["same length here " * 9] * 40, ["x"], []])
def test_packing_places_every_id_once(spark, texts):
    docs = documents(spark, texts) if texts else empty(spark)
    window = 32
    tokens = packing.tokenized(docs, WORDS, window)
    pieces = packing.pack(tokens, window)
    rows = packing.with_ids(packing.checksummed(pieces, tokens), tokens).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == part
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[doc])
    assert len(by_doc) == len(texts)
    short = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        short += at < window
    assert short <= 1


def test_packing_of_awkward_rows(spark):
    tokens = packing.tokenized(awkward(spark), WORDS)
    rows = packing.checksummed(packing.pack(tokens), tokens).collect()
    assert sum(r["length"] for r in rows) == tokens.agg({"doc_tokens": "sum"}).first()[0]
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lexicon_matches_within_one_edit():
    entries = {"moron": (5.0, 4.0), "scum": (3.0, 0.0), "loser": (2.0, 1.0), "vequ*": (6.0, 0.0), "stupid*": (7.0, 2.5)}
    lexicon = toxicity.Lexicon(entries)
    rng = random.Random(4)
    for _ in range(4000):
        word = list(rng.choice(list(entries)).rstrip("*"))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(word))
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "o", "mo"])
        word = "".join(word) + rng.choice(["", "", "ish"])
        exact = near = 0.0
        for entry, (weight, other) in entries.items():
            heads = [word[:n] for n in range(len(word) + 1)] if entry.endswith("*") else [word]
            least = min(edits(h, entry.rstrip("*")) for h in heads)
            exact = max(exact, weight if least == 0 else 0.0)
            # An exact hit is within one edit too where edits that undo one another are counted.
            near = max(near, other if least == 1 else 0.0)
        got = lexicon.match(word)
        assert got[0] == exact, word
        assert got[1] >= near, word
        if not exact:
            assert got[1] == near, word


def test_quotation_is_told_from_abuse():
    scorer = toxicity.Scorer(toxicity.Lexicon({"moron": (5.0, 4.0)}), 80)
    assert scorer.features("you moron") == [5.0, 0.0, 0.0, 0.0]
    assert scorer.features("you m0ron!") == [0.0, 4.0, 0.0, 0.0]
    assert scorer.features('they said "you moron" and left') == [0.0, 0.0, 5.0, 0.0]
    assert scorer.features(None) == scorer.features("") == [0.0] * 4


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(7)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(plain, k=40)
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["blargish", "snorkub", "fuzzlewit"])
        rows.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    docs = documents(spark, [*rows, "a fuzzlwit here", None])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    assert {e.rstrip("*")[:4] for e in model.entries} == {"blar", "snor", "fuzz"}
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 6 == 0) for i in range(900))
    assert got[900]["score"] > got[901]["score"] and got[901]["predicted"] == 0
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(902))
    assert toxicity.without_toxic(docs, model).count() == 902 - sum(r["predicted"] for r in got.values())


def test_toxicity_sample_drops_only_near_copies(spark):
    """Texts of similarity 0.5 and copies with another label all count; of real copies one does."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.choices(words, k=60)
    texts = [" ".join(passage + rng.choices(words, k=30)) for _ in range(60)]
    # The copy of a text that was labelled clean is toxic; the last five say the same.
    own = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = list(zip(own, texts, [i % 2 for i in range(60)], strict=False))
    rows += [(own[60], texts[0], 1), *((own[61 + i], "one two three four five six seven", 0) for i in range(5))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = sorted((r["text"], r["toxic"]) for r in toxicity._sample(docs, labels, toxicity.Options()).collect())
    assert got == sorted({r[1:] for r in rows}) and len(got) == 62


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(awkward(spark), labels)
    rows = toxicity.score(awkward(spark), model).collect()
    assert len(rows) == 7 and all(0 <= r["score"] < 0.5 for r in rows)
    assert toxicity.score(empty(spark), model).count() == 0


def test_mixing_meets_its_targets(spark):
    sizes = {"a": 200, "b": 40, "c": 10}
    sources = [s for s, n in sizes.items() for _ in range(n)]
    docs = documents(spark, ["five words of some text"] * len(sources), sources)
    mixed = mixing.mix(docs, mixing.Target(repetitions=3.0, block_tokens=100)).collect()
    counts = defaultdict(int)
    for r in mixed:
        counts[r["source"]] += r["tokens"]
    # The smallest source is passed over three times, the largest once.
    assert counts["a"] == 1000 and abs(counts["c"] - 150) <= 5
    exponent, weight = mixed[0]["exponent"], {r["source"]: r["weight"] for r in mixed}
    total = sum((n / 250) ** exponent for n in sizes.values())
    assert all(abs(weight[s] - (n / 250) ** exponent / total) < 1e-9 for s, n in sizes.items())
    assert abs(counts["b"] / sum(counts.values()) - weight["b"]) < 0.01
    # Passes have their own order of blocks; a whole pass holds each document once.
    first = [r["row" if "row" in r else "doc_id"] for r in mixed if r["source"] == "a"]
    assert len(first) == len(set(first)) == 200
    places = {(r["pass"], r["block"]): r["place"] for r in mixed if r["source"] == "a"}
    assert len(set(places.values())) == len(places) == 10


def test_mixing_by_entropy_and_budget(spark):
    sources = ["a"] * 90 + ["b"] * 10
    docs = documents(spark, ["two words"] * 100, sources)
    rows = docs.select("source", mixing.token_count(docs.text).alias("tokens"))
    got = {r["source"]: r for r in mixing.weights(rows, mixing.Target(entropy=0.9, budget=100)).collect()}
    p = got["a"]["weight"]
    entropy = -(p * np.log(p) + (1 - p) * np.log(1 - p)) / np.log(2)
    assert abs(entropy - 0.9) < 1e-6 and abs(got["a"]["passes"] - p * 100 / 180) < 1e-6
    mixed = mixing.mix(docs, mixing.Target(entropy=0.9, budget=100, block_tokens=8)).collect()
    assert abs(sum(r["tokens"] for r in mixed if r["source"] == "a") - 100 * p) <= 2


def test_mixing_of_awkward_rows(spark):
    rows = mixing.mix(awkward(spark), carry=("text", "row", "source")).collect()
    assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5}
    assert {r["source"] for r in rows} == {None, "a", "b"} == {r["doc_source"] for r in rows}
    assert mixing.mix(empty(spark)).count() == 0
