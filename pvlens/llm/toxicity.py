"""Toxicity by weak supervision.

Voters: words that labelled rows show in toxic texts in ever different company (a lexicon
learned per table), and patterns (shouting, exclamation runs, symbol noise, a word of the
lexicon soon after "you"). Each voter speaks or stays silent; the human label is one
more, noisy voter. A generative model (EM over two latent classes) estimates how often every voter
speaks in each class, and the correlations between voters: inside a class a voter depends on the
voter it goes with most (a tree of greatest mutual information given the class), so voters that
repeat each other are not counted twice. A logistic classifier on votes and hashed words learns
the posterior labels.

The labelled rows used are a bounded sample (`max_labelled`, smallest hashes first); every
document is scored, on its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, smallest_hashes

PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{4,}\b\W+){3,}"),
    "exclaiming": re.compile(r"!{2,}"),
    "symbols": re.compile(r"[%#&*$@^]{3,}"),
    "stretched": re.compile(r"(?i)([a-z])\1{3,}"),
}
WORDS = re.compile(r"[^\W\d_]+")
HASHED = 1 << 14


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class Scorer:
    """Everything needed to score a text; about 130 KB."""

    lexicon: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hashed: np.ndarray = field(default_factory=lambda: np.zeros(HASHED))
    bias: float = 0.0

    @property
    def voters(self) -> list[str]:
        return [*self.lexicon, *PATTERNS, "you_insult", "two_insults", "many_insults"]

    def votes(self, text: str, words: list[str]) -> np.ndarray:
        at = self.__dict__.get("_at")
        if at is None:
            at = self.__dict__["_at"] = {w: i for i, w in enumerate(self.lexicon)}
        n = len(self.lexicon)
        out = np.zeros(n + len(PATTERNS) + 3, np.int8)
        hits = [i for i, w in enumerate(words) if w in at]
        out[[at[words[i]] for i in hits]] = 1
        for j, pattern in enumerate(PATTERNS.values()):
            out[n + j] = pattern.search(text) is not None
        out[-3] = any("you" in words[max(0, i - 3) : i] for i in hits)
        out[-2], out[-1] = len(hits) >= 2, len(hits) >= 4
        return out

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Votes, and the distinct hashed words."""
        words = WORDS.findall(text.lower())
        marks = {zlib.crc32(w.encode()) & (HASHED - 1) for w in set(words)}
        return self.votes(text, words), np.fromiter(marks, np.int32, len(marks))

    def score(self, text: str) -> float:
        votes, marks = self.features(text)
        z = self.bias + float(votes @ self.weights)
        if len(marks):
            z += float(self.hashed[marks].sum()) / np.sqrt(len(marks))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words, with the smallest word that comes before each in it."""
    for batch in batches:
        out: dict[str, list] = {"word": [], "after": [], "toxic": []}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            before: dict[str, str] = {}
            words = WORDS.findall(text.lower())
            for word, last in zip(words, ["", *words]):
                before[word] = min(before.get(word, last), last)
            out["word"] += before
            out["after"] += before.values()
            out["toxic"] += [toxic] * len(before)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("word", pa.string()), ("after", pa.string()), ("toxic", pa.int32())]))


def learn_lexicon(rows: DataFrame, most: int = 64, least_texts: int = 4, least_odds: float = 2.5) -> list[str]:
    """Words of toxic texts, from (text, toxic), one row a distinct text.

    A word must come in `least_texts` toxic texts, be more likely there by e^least_odds, and
    follow a different word in most of them: copies of one text teach nothing.
    """
    count = lambda toxic: F.count_if(F.col("toxic") == toxic)
    pairs = rows.select("text", "toxic").mapInArrow(_in_slices(_word_batches, 64), "word string, after string, toxic int").groupBy("word", "after").agg(count(1).alias("p"), count(0).alias("n"))
    stats = pairs.groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.count_if(F.col("p") > 0).alias("company"))
    total = rows.agg(count(1).alias("p"), count(0).alias("n")).first()
    odds = F.log((F.col("p") + 0.5) / (total.p + 1)) - F.log((F.col("n") + 0.5) / (total.n + 1))
    found = stats.where((F.col("p") >= least_texts) & (F.col("company") >= F.col("p") * 0.6) & (odds >= least_odds)).select("word", (odds * F.sqrt("p")).alias("w")).orderBy(F.desc("w"), "word").limit(most)
    return [r.word for r in found.collect()]


@dataclass
class LabelModel:
    """Class prior and, for each voter, the voter it depends on (-1: none) and its chance to speak.

    speaks[y, s, j]: in class y, where the parent of j is silent (s = 0) or speaks (1).
    """

    prior: float
    parent: np.ndarray
    speaks: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(int)
        state = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0)
        at = np.arange(v.shape[1])
        chance = self.speaks[:, state, at]
        each = np.log(np.where(v == 1, chance, 1 - chance)).sum(2)
        z = np.log(self.prior / (1 - self.prior)) + each[1] - each[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def dependencies(both: np.ndarray, single: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Parents of the voters: the forest of greatest mutual information given the class.

    both[y, i, j], single[y, i], size[y]: weighted counts of i and j speaking, of i speaking, of
    documents. Voters whose correlation stays below `least` in both classes are not linked.
    """
    m = single.shape[1]
    information, strongest = np.zeros((m, m)), np.zeros((m, m))
    for y in (0, 1):
        n = size[y] + 1e-9
        pi, pj, p11 = single[y][:, None] / n, single[y][None, :] / n, both[y] / n
        scale = np.sqrt(np.maximum(pi * (1 - pi) * pj * (1 - pj), 1e-12))
        # A class in which a pair is hardly ever heard says nothing about it.
        heard = np.minimum(single[y][:, None], single[y][None, :]) >= 3
        strongest = np.maximum(strongest, np.where(heard, np.abs(p11 - pi * pj) / scale, 0))
        for p, q, r in ((p11, pi, pj), (pi - p11, pi, 1 - pj), (pj - p11, 1 - pi, pj), (1 - pi - pj + p11, 1 - pi, 1 - pj)):
            information += size[y] * np.where(p > 1e-12, p * np.log(np.maximum(p, 1e-12) / np.maximum(q * r, 1e-12)), 0)
    usable = (strongest >= least) & ~np.eye(m, dtype=bool)
    parent, done = np.full(m, -1), np.zeros(m, bool)
    for root in range(m):
        if done[root]:
            continue
        done[root] = True
        while True:
            gain = np.where(usable & done[:, None] & ~done[None, :], information, -np.inf)
            i, j = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[i, j] <= 0:
                break
            parent[j], done[j] = i, True
    return parent


def fit_label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 20, least: float = 0.2) -> LabelModel:
    """EM over (documents, voters) 0/1 votes; gold is the noisy human label and the last voter.

    Its errors are taken as independent of the other voters, whose tree is found anew each round.
    """
    v = np.column_stack([votes, gold]).astype(float)
    n, m = v.shape
    q = np.where(gold == 1, np.where(votes.any(axis=1), 0.95, 0.4), 0.02)
    for _ in range(rounds):
        weights = np.array([1 - q, q])
        size = weights.sum(1)
        single = weights @ v
        both = np.stack([(v * w[:, None]).T @ v for w in weights])
        parent = np.append(dependencies(both[:, :-1, :-1], single[:, :-1], size, least), -1)
        alone = np.clip((single + 0.05) / (size + 1)[:, None], 1e-4, 1 - 1e-4)
        speaks = np.stack([alone, alone], 1)
        for j in np.flatnonzero(parent >= 0):
            i = parent[j]
            for y in (0, 1):
                for s, (hits, cases) in enumerate(((single[y, j] - both[y, i, j], size[y] - single[y, i]), (both[y, i, j], single[y, i]))):
                    speaks[y, s, j] = (hits + 2 * alone[y, j]) / (cases + 2)
        model = LabelModel((size[1] + 1) / (n + 2), parent, np.clip(speaks, 1e-4, 1 - 1e-4))
        q = model.posterior(v)
    return model


def fit_classifier(votes: np.ndarray, marks: list[np.ndarray], soft: np.ndarray, rounds: int = 200, l2: float = 1e-3, l2_words: float = 3e-2) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on posterior labels: weights of votes and of hashed words, and the bias."""
    n = len(votes)
    lens = np.array([len(m) for m in marks])
    flat = np.concatenate(marks) if n else np.zeros(0, np.int32)
    row = np.repeat(np.arange(n), lens)
    each = np.repeat(1 / np.sqrt(np.maximum(lens, 1)), lens)
    x = votes.astype(float)
    w, h, b = np.zeros(x.shape[1]), np.zeros(HASHED), float(np.log((soft.mean() + 1e-3) / (1 - soft.mean() + 1e-3)))
    gw, gh, gb = np.full(x.shape[1], 1e-8), np.full(HASHED, 1e-8), 1e-8
    for _ in range(rounds):  # AdaGrad over the whole sample
        z = b + x @ w + np.bincount(row, weights=h[flat] * each, minlength=n)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) / n
        dw, db = x.T @ e + l2 * w / n, e.sum()
        dh = np.bincount(flat, weights=e[row] * each, minlength=HASHED) + l2_words * h / n
        gw, gh, gb = gw + dw**2, gh + dh**2, gb + db**2
        w, h, b = w - 0.5 * dw / np.sqrt(gw), h - 0.02 * dh / np.sqrt(gh), b - 0.3 * db / np.sqrt(gb)
    return w, h, float(b)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8192) -> Scorer:
    """Fit on a bounded sample of labelled rows outside the held-out quarter; equal texts count once.

    An id labelled twice counts as toxic if either label says so. Without a labelled text nothing is known, and the scorer gives every text a score near 0.
    """
    key = F.col("doc_id").cast("long")
    marked = labels.where(F.col("toxic").isin(0, 1) & ~held_out(key)).select(key.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("labelled"))
    some = smallest_hashes(marked, order, max_labelled).orderBy(order, "doc_id").limit(max_labelled)
    some = materialize(some, "labelled")
    rows = docs.select(key.alias("doc_id"), "text").where(F.length("text") > 0).join(F.broadcast(some), "doc_id")  # at most max_labelled rows
    rows = rows.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("_t")).agg(F.first("text").alias("text"), F.min("toxic").alias("toxic")).drop("_t")
    rows = materialize(rows, "labelled-texts")
    scorer = Scorer(learn_lexicon(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scorer.features(t) for t in batch.column("text").to_pylist()]
            marks = np.zeros((len(found), HASHED), bool)
            for i, (_, m) in enumerate(found):
                marks[i, m] = True
            packed = [x.tobytes() for x in np.packbits(marks, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array(packed, pa.binary()), batch.column("toxic")], ["v", "m", "toxic"])

    # At most max_labelled rows of about 2 KB each, whatever the texts are.
    sample = rows.select("text", "toxic").mapInArrow(_in_slices(run), "v binary, m binary, toxic int").collect()
    if not sample:
        scorer.weights, scorer.bias = np.zeros(len(scorer.voters)), -10.0
        return scorer
    sample.sort(key=lambda r: (bytes(r.v), bytes(r.m), r.toxic))
    votes = np.array([np.frombuffer(r.v, np.int8) for r in sample])
    marks = [np.flatnonzero(np.unpackbits(np.frombuffer(r.m, np.uint8))).astype(np.int32) for r in sample]
    gold = np.array([r.toxic for r in sample])
    model = fit_label_model(votes, gold)
    soft = model.posterior(np.column_stack([votes, gold]))
    scorer.weights, scorer.hashed, scorer.bias = fit_classifier(votes, marks, soft)
    return scorer


def _in_slices(run, size: int = 512):
    """run over slices of the batches, which bounds the memory of its arrays."""
    return lambda batches: run(batch.slice(a, size) for batch in batches for a in range(0, len(batch), size))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = 8192, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (and kept columns) for every row.

    The whole text is scored, and nothing else of the row; null and empty texts score as a text
    without words. Without labels no text is predicted toxic. Repeated rows score alike;
    null ids are not held out and never labelled; an empty table gives no rows; other columns are
    ignored unless kept.
    """
    scorer = train(docs, labels, max_labelled)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [scorer.score(t or "") for t in batch.column("_text").to_pylist()]
            cols = [batch.column("_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), *(batch.column(f"_keep_{i}") for i in range(len(keep)))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", *keep])

    rows = docs.select(F.col("doc_id").alias("_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("_text"), *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)))
    schema = f"doc_id {fields['doc_id']}, held_out boolean, score double, predicted int" + "".join(f", `{c}` {fields[c]}" for c in keep)
    return rows.mapInArrow(_in_slices(run), schema)
