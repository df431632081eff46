"""Toxicity (operator 5): averaged subword embeddings under a linear softmax.

A word is the mean of its hashed character n-gram vectors, a window of words
is the mean of its words, and a softmax over the window mean is trained
jointly with the vectors.  A document is as toxic as its worst window, so a
passage counts in a text of any length: training alternates between choosing
each document's worst windows (at first by feature log-odds) and fitting them.  Misspelt words share
n-grams with words that were seen.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import sliced
from .held import Remembered, tidy
from .sampling import sampled
from .subwords import GLUE, buckets, in_fold, in_process, ngrams, unglued

#: Rows of either label that training collects at most, and their length in code points.
MOST_ROWS, LONGEST_TEXT = 1000, 1 << 15
FEATURES, WIDTH, SHORTEST, LONGEST = 1 << 16, 4, 3, 5
#: Words of a window; one starts at every word.
WINDOW = 4
ROUNDS, STEPS = 5, 60
#: Windows of a clean document that one round fits.
HARDEST = 3
#: Documents' worth of the common rate that a feature's rates start from, and the share of clean texts that a toxic one's worst window has to surpass to be learnt from.
PRIOR, DOUBT = 2.0, 0.9
#: Weight of all clean windows together; toxic ones weigh the rest.
CLEAN_SHARE = 0.6
THRESHOLD = 0.3
#: Longer words are cut into pieces about as long as a usual word.
LONGEST_WORD, PIECE = 40, 8
MEMORY = 400_000
EDGES = regex.compile(rf"^{GLUE.pattern}|{GLUE.pattern}$")


def words(text: str | None) -> list[str]:
    """Words at white space; glued and unspaced ones of any length come in pieces, each a word."""
    return unglued((text or "").split(), LONGEST_WORD, PIECE, LONGEST - 1)


def normal(token: str) -> str:
    """What makes a word the same word: not its case and not what stands at its edges."""
    return EDGES.sub("", token.lower())


def name(token: str) -> int:
    """A number that a word has in every text."""
    return int.from_bytes(hashlib.blake2b(normal(token).encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def features(token: str) -> list[int]:
    """Feature numbers of a token; one without letters or digits has none."""
    word = normal(token)
    return buckets([f"={word}", *ngrams(word, SHORTEST, LONGEST)], FEATURES) if word else []


def windows(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Sums of the values of each window; a name that a window repeats counts once in it."""
    width = min(WINDOW, len(names))
    count = len(names) - width + 1
    same = [names[lag:] == names[:-lag] for lag in range(1, width)]
    total = values[:count].copy()
    for at in range(1, width):
        again = np.zeros(count, bool)
        for lag in range(1, at + 1):
            again |= same[lag - 1][at - lag : at - lag + count]
        total += np.where(again, 0.0, values[at : at + count])
    return total


class Model:
    """Vectors and softmax folded to one number per feature, and the bias."""

    def __init__(self, feature_scores: np.ndarray, bias: float):
        self.feature_scores, self.bias = feature_scores, bias
        self.listed = feature_scores.tolist()
        self.known, self.names = Remembered(self.word, MEMORY), Remembered(name, MEMORY)

    def word(self, token: str) -> float:
        own = features(token)
        return sum(map(self.listed.__getitem__, own)) / len(own) if own else 0.0

    def values(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds, and which word it is."""
        own = words(text)
        return np.fromiter(map(self.known.__getitem__, own), np.float64, len(own)), np.fromiter(map(self.names.__getitem__, own), np.int64, len(own))

    def score(self, found: tuple[np.ndarray, np.ndarray]) -> float:
        """Probability of a text from its words' values and names; a word that a window repeats counts once in it."""
        logit, (values, names) = self.bias, found
        if len(values):
            logit += float(windows(values, names).max() / WINDOW)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit on whole texts; with one label only, a constant score."""
    y = np.array(labels, np.float64)
    rate = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), float(np.log(rate / (1 - rate))))
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(normal(w), len(number)) for w in words(t)], np.int32) for t in texts]
    flat_table, amounts = array("i"), array("i")
    for w in number:
        own = features(w) or [FEATURES]
        flat_table.extend(own)
        amounts.append(len(own))
    table, amount = np.frombuffer(flat_table, np.int32), np.frombuffer(amounts, np.int32).astype(np.float64)
    del number
    first = np.concatenate([[0], np.cumsum(amount[:-1])]).astype(np.int64)
    rng = np.random.default_rng(seed)
    weights = [np.vstack([rng.normal(0, 0.1, (FEATURES, WIDTH)), np.zeros(WIDTH)]), rng.normal(0, 0.1, (WIDTH, 2)), np.zeros(2)]
    optimiser = Adam(weights)
    values = np.add.reduceat(rarity(docs, y, table, first, amount)[table], first) / amount
    for _ in range(ROUNDS):
        bags, want = worst_windows(docs, y, values)
        owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        used, flat = np.unique(np.concatenate(bags), return_inverse=True)
        used_table = np.concatenate([table[first[u] : first[u] + int(amount[u])] for u in used])
        used_amount = amount[used]
        used_first = np.concatenate([[0], np.cumsum(used_amount[:-1])]).astype(np.int64)
        spread = np.repeat(np.arange(len(used)), used_amount.astype(np.int64))
        weight = np.where(want == 1, (1 - CLEAN_SHARE) / max(1, (want == 1).sum()), CLEAN_SHARE / max(1, (want == 0).sum()))
        for _ in range(STEPS):
            vectors, top, bias = weights
            word = np.add.reduceat(vectors[used_table], used_first) / used_amount[:, None]
            mean = np.stack([np.bincount(owner, word[flat, k], len(bags)) for k in range(WIDTH)], 1) / WINDOW
            z = mean @ top + bias
            p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))
            g = ((p - want) * weight)[:, None] * np.array([-1.0, 1.0])
            back = g @ top.T
            to_word = np.stack([np.bincount(flat, back[owner, k], len(used)) for k in range(WIDTH)], 1) / (WINDOW * used_amount[:, None])
            to_vector = np.stack([np.bincount(used_table, to_word[spread, k], FEATURES + 1) for k in range(WIDTH)], 1)
            to_vector[FEATURES] = 0
            optimiser.step([to_vector, mean.T @ g + 1e-4 * top, g.sum(0)])
        values = np.add.reduceat(folded(weights)[table], first) / amount
    return Model(folded(weights)[:FEATURES], float(weights[2][1] - weights[2][0]))


def folded(weights: list[np.ndarray]) -> np.ndarray:
    """One number per feature: what its vector adds to the toxic logit."""
    return weights[0] @ (weights[1][:, 1] - weights[1][:, 0])


def rarity(docs: list[np.ndarray], labels: np.ndarray, table: np.ndarray, first: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """Log-odds of each feature's presence in toxic texts: ranks windows before anything is learnt."""
    seen = np.zeros((2, FEATURES + 1))
    for d, label in zip(docs, labels, strict=True):
        own = np.unique(d)
        if len(own):
            seen[int(label), np.unique(np.concatenate([table[first[u] : first[u] + int(amount[u])] for u in own]))] += 1
    texts = np.array([[(labels == 0).sum()], [(labels == 1).sum()]])
    share = (seen + PRIOR * (seen.sum(0) + 0.5) / (texts.sum() + 1)) / (texts + PRIOR)
    odds = np.log(share[1] / share[0])
    odds[FEATURES] = 0
    return odds


def worst_windows(docs: list[np.ndarray], labels: np.ndarray, values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The windows to fit next: the worst of each toxic text, the HARDEST of each clean one, and empty windows as clean.

    A toxic text whose worst window looks like that of most clean ones says
    nothing yet about what is toxic, as where its label is wrong, and is left
    out of the round.
    """
    found = [windows(values[d], d) if len(d) else np.zeros(1) for d in docs]
    worst = np.array([f.max() for f in found])
    telling = worst > np.quantile(worst[labels == 0], DOUBT)
    if not telling[labels == 1].any():
        telling[:] = True
    empty = 1 + len(docs) // 20
    bags, want = [np.zeros(0, np.int32)] * empty, [0.0] * empty
    for d, label, sums, tells in zip(docs, labels, found, telling, strict=True):
        if len(d) and (not label or tells):
            chosen = np.argsort(-sums, kind="stable")[: 1 if label else HARDEST]
            bags += [np.unique(d[i : i + WINDOW]) for i in chosen]
            want += [label] * len(chosen)
    return bags, np.array(want)


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float = 0.1):
        self.weights, self.rate, self.clock = weights, rate, 0
        self.mean, self.square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.clock += 1
        for w, g, m, v in zip(self.weights, gradients, self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.clock)) / (np.sqrt(v / (1 - 0.99**self.clock)) + 1e-8)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, most: int = MOST_ROWS) -> Model:
    """Train on at most ``most`` labelled documents of either label outside the held-out fold.

    The sample is drawn from the narrow labels; only its documents' texts move,
    and those of more than LONGEST_TEXT code points are not learnt from.
    """
    spark = docs.sparkSession
    usable = F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out)
    known = labels.where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [(r.doc_id, r.toxic) for label in (1, 0) for r in sampled(known.where(F.col("toxic") == label), most)]
    wanted = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int"))  # 2 * most rows at most
    found = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST_TEXT).join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: r.doc_id)
    return train([r.text for r in found], [r.toxic for r in found])


def toxicity(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts get the score of no words; without labelled rows all
    scores are one constant.  Repeated rows score alike; a null id hashes as
    empty text.  An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.feature_scores, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature_scores, bias = shared.value
        model = in_process("toxicity", [feature_scores, np.array([bias])], lambda: Model(feature_scores, bias))
        for batch in sliced(batches):
            values = pa.array([model.score(model.values(t)) for t in batch.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["doc_id", "held_out", "score"])

    rows = docs.select(docs["doc_id"].alias("doc_id"), in_fold(docs["doc_id"], folds, held_out).alias("held_out"), docs["text"].alias("text"))
    scored = rows.mapInArrow(tidy(score, "toxicity"), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
