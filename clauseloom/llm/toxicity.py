"""Toxicity by a learnt lexicon, misspellings included.

A lexicon of terms and stems is learnt from labelled documents.  It is kept as a trie;
the Levenshtein automata of all its entries run over the trie together, and the states
they reach are determinised as words arrive, so a word costs one table look-up a
character.  Hits are weighed by how sure their entry is, apart for exact and misspelled
ones, and apart for those that a window of context shows to be quoted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm import near_dedup
from clauseloom.llm.common import discard, slices, stored

LIMIT = 30.0  # of a feature; log odds beyond it tell nothing more
CACHED_WORDS = 300_000  # entries a Python worker keeps
WORD = re.compile(r"[^\W_]+")
EDGES = ".,;:!?\"'()“”„«»‹›"
QUOTES = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("‹", "›"))


@dataclass(frozen=True)
class Options:
    """``sample_rows``: most labelled documents that the model is fitted on (about; chosen by hash).
    ``entries``: most lexicon entries.  ``stems``: lengths of word beginnings that may become
    entries.  ``evidence``: how far the likelihood ratio of an entry must exceed chance.
    ``edit_length``: shortest entry that may be misspelled; ``edit_share``: what a misspelled
    hit counts of the entry's weight before any were seen.  ``context``: characters on each
    side of a hit that are searched for quotation marks."""

    sample_rows: int = 20_000
    entries: int = 4_000
    stems: tuple[int, ...] = (4, 5, 6, 7)
    evidence: float = 4.0
    edit_length: int = 5
    edit_share: float = 0.8
    context: int = 80


Hit = tuple[float, float, int]
NO_HIT: Hit = (0.0, 0.0, -1)


def joined(a: Hit, b: Hit) -> Hit:
    return (max(a[0], b[0]), *(a[1:] if a[1] >= b[1] else b[1:]))


class Lexicon:
    """Trie of entries with a weight for exact and one for misspelled hits; finds the best within one edit.

    An entry that ends in ``*`` is a stem: it fits words that begin with it.  A weight of 0
    for misspelled hits allows none.
    """

    def __init__(self, entries: dict[str, tuple[float, float]]):
        self.names = sorted(entries)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool]]] = [[]]
        self.weights = [entries[name] for name in self.names]
        for number, entry in enumerate(self.names):
            stem = entry.endswith("*")
            node = 0
            for char in entry.rstrip("*"):
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][char]
            self.ends[node].append((number, stem))
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[Hit, Hit]] = []  # for each state: hits of words that end there, and of all that pass
        self.start = self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        """Number of the set of (trie node, edits) with deletions followed; nodes of no use are left out."""
        full = dict[int, int]()
        todo = sorted(places, key=lambda x: x[1])
        while todo:
            node, edits = todo.pop(0)
            if full.get(node, 9) <= edits:
                continue
            full[node] = edits
            if edits == 0:
                todo += [(child, 1) for child in self.children[node].values()]
        key = frozenset(full.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.found.append((self._best(full, False), self._best(full, True)))
        return self.states[key]

    def _best(self, full: dict[int, int], stems_only: bool) -> Hit:
        exact, near, which = 0.0, 0.0, -1
        for node, edits in full.items():
            for number, stem in self.ends[node]:
                if stems_only and not stem:
                    continue
                weight = self.weights[number][edits]
                if edits == 0:
                    exact = max(exact, weight)
                elif weight > near:
                    near, which = weight, number
        return (exact, near, which) if exact or near else NO_HIT

    def match(self, word: str) -> Hit:
        """Greatest weights of an exact and of a misspelled hit of the word, and the latter's entry."""
        state, best = self.start, NO_HIT
        for char in word:
            following = self.moves[state].get(char)
            if following is None:
                places = set()
                for node, edits in self.sets[state]:
                    child = self.children[node].get(char)
                    if child is not None:
                        places.add((child, edits))
                    if edits == 0:
                        places.add((node, 1))  # the character is one too many
                        places.update((other, 1) for other in self.children[node].values())  # or another
                following = self.moves[state][char] = self._state(places) if places else -1
            state = following
            if state < 0:
                return best
            passing = self.found[state][1]
            if passing is not NO_HIT:
                best = joined(best, passing)
        return joined(best, self.found[state][0])


def words_of(text: str) -> list[str]:
    return text.lower().split()


def quoted(text: str, start: int, end: int, context: int) -> bool:
    """True if the nearest marks within ``context`` characters open before and close behind the span."""
    left, right = text[max(0, start - context) : start], text[end : end + context]
    for opening, closing in QUOTES:
        if opening == closing:
            if left.count(opening) % 2 and closing in right:
                return True
        elif left.rfind(opening) > left.rfind(closing) and closing in right:
            return True
    return False


class Scorer:
    """Features of texts: for (exact, misspelled) x (abuse, quotation) the sum of the distinct hits' weights."""

    def __init__(self, lexicon: Lexicon, context: int):
        self.lexicon = lexicon
        self.context = context
        self.known: dict[str, Hit | None] = {}

    def _look(self, token: str) -> Hit | None:
        parts = WORD.findall(token)
        if len(parts) > 1 or (parts and len(parts[0]) < len(token.strip(EDGES))):
            parts.append("".join(parts))
        best = NO_HIT
        for part in parts:
            best = joined(best, self.lexicon.match(part))
        return best if best[0] or best[1] else None

    def hits(self, text: str | None) -> tuple[str, list[tuple[str, Hit]]]:
        """Lower-case text and its distinct tokens that hit."""
        lower = text.lower() if text else ""
        distinct = set(lower.split())
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for token in distinct:
            if token not in known:
                known[token] = self._look(token)
        found = [(token, known[token]) for token in sorted(t for t in distinct if known[t])]
        for token in distinct:
            if len(token) > 64:
                known.pop(token)
        return lower, found

    def features(self, text: str | None) -> list[float]:
        sums = [0.0, 0.0, 0.0, 0.0]
        lower, found = self.hits(text)
        for token, (exact, near, _) in found:
            # Abuse if any of its places is not a quotation.
            head, tail = len(token) - len(token.lstrip(EDGES)), len(token.rstrip(EDGES))
            inside = all(quoted(lower, at + head, at + tail, self.context) for at in _places(lower, token))
            sums[(not exact) + 2 * inside] += exact or near
        return [min(x, LIMIT) for x in sums]


def _places(text: str, token: str) -> list[int]:
    """Where ``token`` stands between white space or the text's ends."""
    found, place = [], text.find(token)
    while place >= 0:
        end = place + len(token)
        if (place == 0 or text[place - 1].isspace()) and (end == len(text) or text[end].isspace()):
            found.append(place)
        place = text.find(token, end)
    return found


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, options: Options) -> DataFrame:
    """Texts of at most about ``sample_rows`` labelled documents that are not held out: text, toxic, fold."""
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out()).select("doc_id", "toxic")
    rows = usable.count()
    share = min(1.0, options.sample_rows / max(rows, 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    # At most about sample_rows narrow rows: the bound of the broadcast side.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Texts that share a doc_id are told apart: only what they say makes them copies.
    texts = stored(
        texts.select(
            "doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"), (fold == 4).alias("tuning"),
            F.xxhash64("doc_id", "text").alias("row"),
        )
    )
    # Of near copies with one label one speaks; their words would pass for evidence otherwise.
    alike = near_dedup.near_duplicates(texts.select("row", "text").dropDuplicates(["row"]), key="row")
    groups = texts.select("row", "doc_id", "toxic").join(alike.select("row", "component_id"), "row")
    speakers = groups.groupBy("component_id", "toxic").agg(F.min_by("row", F.struct("doc_id", "row")).alias("row"))
    speakers = F.broadcast(speakers.select("row", "toxic"))
    sample = stored(texts.join(speakers, ["row", "toxic"]).dropDuplicates(["row", "toxic"]).drop("doc_id", "row"))
    discard(texts)
    return sample


def _terms(options: Options):
    """Per task: each word and stem with the number of toxic and clean documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in slices(batches, "text", 4 << 20):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {part for token in set(words_of(text or "")) for part in WORD.findall(token) if len(part) <= 32}
                own |= {f"{word[:n]}*" for word in tuple(own) for n in options.stems if len(word) > n}
                (toxic if label else clean).update(own)
        every = list(toxic | clean)
        for at in range(0, len(every), 50_000):
            part = every[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())],
                names=["term", "toxic", "clean"],
            )

    return run


def learn_lexicon(sample: DataFrame, options: Options) -> dict[str, float]:
    """Entries with weights: terms far more frequent in toxic documents than chance allows.

    The likelihood ratio must exceed what the most extreme of all terms reaches by chance.
    A term covered by one of its own stems that is as sure is left out.
    """
    counts = sample.groupBy().agg(F.sum("toxic"), F.count("*")).first()
    bad, total = int(counts[0] or 0), int(counts[1])
    if not bad or bad == total:
        return {}
    terms = sample.select("text", "toxic").mapInArrow(_terms(options), "term string, toxic long, clean long")
    terms = terms.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a >= 3")
    p = bad / total
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    rate = a / (a + b)
    ratio = 2 * (
        a * F.log(rate / p) + F.when(F.col("b") > 0, b * F.log((1 - rate) / (1 - p))).otherwise(F.lit(0.0))
    )
    sure = F.log(((a + 0.5) / (bad + 1)) / ((b + 0.5) / (total - bad + 1)))
    scored = terms.withColumn("ratio", F.when(rate > p, ratio)).withColumn("weight", sure)
    tried = math.log(max(terms.count(), 2))
    rows = (
        scored.where((F.col("ratio") > 2 * tried + options.evidence) & (F.col("weight") > 1.5))
        .orderBy(F.desc("ratio"), "term")
        .limit(options.entries)
        .collect()
    )
    return _without_covered(rows, bad, total, options)


def _odds(a: float, b: float, bad: int, total: int) -> float:
    """Smoothed log of how much more frequent a term is in toxic than in clean documents."""
    return math.log(((a + 0.5) / (bad + 1)) / ((b + 0.5) / (total - bad + 1)))


def _without_covered(rows: list, bad: int, total: int, options: Options, slack: float = 0.5) -> dict[str, float]:
    """Drop terms that a stem as sure covers, and stems that are sure only through their surer terms.

    Covered whole words that may be misspelled stay: the stem says nothing of their end.
    """
    weights = {row["term"]: row["weight"] for row in rows}
    finer: dict[str, list] = {}
    for row in rows:
        base = row["term"].rstrip("*")
        for n in range(1, len(base) + (row["term"][-1] != "*")):
            stem = f"{base[:n]}*"
            if stem in weights and row["weight"] > weights[stem] + slack:
                finer.setdefault(stem, []).append(row)
    kept = {}
    for row in rows:
        # Of the surer terms only the longest stems count, so that no document is taken off twice for one word.
        own = finer.get(row["term"], [])
        own = [r for r in own if not any(r is not s and s["term"].endswith("*") and r["term"].startswith(s["term"][:-1]) for s in own)]
        rest = _odds(max(0, row["a"] - sum(r["a"] for r in own)), max(0, row["b"] - sum(r["b"] for r in own)), bad, total)
        if not own or rest > 1.5:
            kept[row["term"]] = rest if own else row["weight"]
    return {
        term: weight
        for term, weight in kept.items()
        if (term[-1] != "*" and len(term) >= options.edit_length)
        or not any(kept.get(f"{term.rstrip('*')[:n]}*", -1.0) >= weight - slack for n in range(1, len(term)) if f"{term[:n]}*" != term)
    }


def weigh_misspellings(sample: DataFrame, entries: dict[str, float], options: Options) -> dict[str, tuple[float, float]]:
    """Entries with the weights of exact and of misspelled hits.

    Misspelled hits are counted in the documents the entries were learnt from: an entry
    whose neighbours are ordinary words loses them.
    """
    editable = {e: (w, options.edit_share * w if len(e.rstrip("*")) >= options.edit_length else 0.0) for e, w in entries.items()}
    counts = sample.groupBy().agg(F.sum("toxic"), F.count("*")).first()
    bad, total = int(counts[0] or 0), int(counts[1])
    if not entries:
        return editable

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon(editable), options.context)
        names = scorer.lexicon.names
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches, "text", 4 << 20):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[label].update({names[which] for _, (exact, _, which) in scorer.hits(text)[1] if not exact})
        every = sorted(set().union(*seen))
        yield pa.RecordBatch.from_arrays(
            [pa.array(every, pa.string()), *(pa.array([own[e] for e in every], pa.int64()) for own in seen)],
            names=["entry", "clean", "toxic"],
        )

    seen = sample.select("text", "toxic").mapInArrow(run, "entry string, clean long, toxic long").groupBy("entry").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    for entry, clean, toxic in seen.collect():  # at most one row for each entry
        exact, near = editable[entry]
        odds = _odds(toxic, clean, bad, total)
        editable[entry] = (exact, min(near, odds) if odds > 1.0 else 0.0)
    return editable


def fit(features: np.ndarray, labels: np.ndarray, prior: np.ndarray, pull: float = 0.5, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards ``prior`` (intercept first)."""
    x = np.concatenate([np.ones((len(features), 1)), features], axis=1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - labels @ z + pull / 2 * ((w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), grad)
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * step) > now:
            scale /= 2
        w = w - scale * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0.0)  # a hit never speaks for a document
    return w


@dataclass(frozen=True)
class Model:
    """A bounded lexicon and five weights; small enough to travel with the tasks."""

    entries: dict[str, tuple[float, float]]
    weights: tuple[float, ...]
    options: Options


PRIOR = np.array([-2.2, 1.0, 0.8, 0.5, 0.4])  # intercept, exact, misspelled, exact quoted, misspelled quoted


def train(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Model:
    """Lexicon from most of the sampled documents, weights from those kept apart for tuning."""
    sample = _sample(docs, labels, options)
    learning = sample.where("not tuning")
    entries = weigh_misspellings(learning, learn_lexicon(learning, options), options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon(entries), options.context)
        for batch in slices(batches, "text", 4 << 20):
            rows = [scorer.features(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "f"])

    # One short row for each sampled document.
    rows = sample.where("tuning").select("text", "toxic").mapInArrow(run, "toxic int, f array<double>").toPandas()
    weights = PRIOR
    if len(rows):
        weights = fit(np.array(rows["f"].tolist()).reshape(len(rows), 4), rows["toxic"].to_numpy(float), PRIOR)
    return Model(entries, tuple(map(float, weights)), options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and the four features.

    Map-only.  Null and empty texts score as texts without a hit; a null key is not held
    out; repeated rows are scored each; other columns are ignored; an empty table gives no
    rows.  A model fitted without toxic documents finds no hits and scores all texts alike.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("exact", "misspelled", "exact_quoted", "misspelled_quoted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon(model.entries), model.options.context)
        weights = np.array(model.weights)
        for batch in slices(batches, "text", 4 << 20):
            rows = np.array([scorer.features(text) for text in batch.column("text").to_pylist()]).reshape(-1, 4)
            scores = 1 / (1 + np.exp(-(weights[0] + rows @ weights[1:])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), *(pa.array(rows[:, i]) for i in range(4))],
                names=["doc_id", "score", *names],
            )

    schema = f"doc_id {kind}, score double, {', '.join(f'{n} double' for n in names)}"
    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *names,
    )


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns.  Map-only; order kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon(model.entries), model.options.context)
        weights = np.array(model.weights)
        for batch in slices(batches, "text", 4 << 20):
            rows = np.array([scorer.features(text) for text in batch.column("text").to_pylist()]).reshape(-1, 4)
            yield batch.filter(pa.array(1 / (1 + np.exp(-(weights[0] + rows @ weights[1:]))) < limit))

    return docs.mapInArrow(run, docs.schema)
