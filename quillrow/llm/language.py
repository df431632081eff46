"""Language identification (operator 8) by a linear-chain conditional random field.

Every word gets scores from its affixes, character n-grams and a learnt
lexicon; learnt transitions tie neighbours together, and forward-backward
gives each word's posterior, so code-switched texts split into their parts.
A document's language is the label with the largest mean posterior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import sliced
from .held import tidy
from .sampling import sampled_by
from .subwords import in_fold, in_process, unglued

#: Labelled rows of each language that training collects at most, their length in code points, and the words it fits.
MOST_ROWS, LONGEST_TEXT, MOST_WORDS = 200, 1 << 15, 120_000
FEATURES = 1 << 15
#: Words of a training segment, segments of a training chain, words of a chain at prediction.
SEGMENT, SEGMENTS, CHAIN = 8, 4, 64
#: Share of training segments moved to another place, so that languages meet in a chain.
MOVED = 0.15
STEPS = 60
#: A lexicon word occurs so often, in one language so mostly; so many a language.
LEXICON_COUNT, LEXICON_SHARE, LEXICON_SIZE = 5, 0.8, 400
#: Longer words are cut into pieces about as long as a usual word.
LONGEST_WORD, PIECE = 40, 8
MEMORY = 200_000
#: Words whose posteriors are computed together, and code points that are split into words at a time.
GROUP, STRETCH = 50_000, 1 << 16
UNKNOWN = "und"
#: Letters are Unicode's category L; marks belong to the letter before them.
LETTER, NOT_LETTERS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")
WHITE = regex.compile(r"\s")


def tokens(text: str) -> list[str]:
    """Words at white space; glued and unspaced ones of any length come in pieces, each a word."""
    return unglued(text.split(), LONGEST_WORD, PIECE, 2)


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text in parts of about ``size`` code points, cut at white space; where none follows for as long again, inside the word."""
    at = 0
    while at < len(text):
        gap = WHITE.search(text, at + size, at + 2 * size)
        end = gap.start() if gap else min(len(text), at + 2 * size)
        yield text[at:end]
        at = end


def letters(token: str) -> str:
    """A token's letters, empty if it has none."""
    if token.isalpha():
        return token.lower()
    return NOT_LETTERS.sub("", token).lower() if LETTER.search(token) else ""


def _hashed(parts: list[np.ndarray], kind: int) -> np.ndarray:
    """Feature numbers of tuples of code points (columns of equal length) of one kind."""
    total = np.full(len(parts[0]), kind, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            total = (total ^ p) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
    return (total & np.uint64(FEATURES - 1)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words of letters, and where each word's begin: the word, its affixes, trigrams with its bounds, its lexicon."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(size + 2) - size - 2
    owner = np.repeat(np.arange(len(words)), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    at = start[owner] + inside  # of each word's places the one before
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(codes[at + 1] * (np.uint64(0x100000001B3) ** (inside.astype(np.uint64) + np.uint64(1))), np.cumsum(size) - size)
    found, owners = [_hashed([whole], 1), _hashed([codes[at], codes[at + 1], codes[at + 2]], 2)], [np.arange(len(words)), owner]
    none = np.zeros(len(words), np.uint64)
    first = [np.where(size > i, codes[start + 1 + np.minimum(i, size - 1)], none) for i in range(3)]
    last = [np.where(size > i, codes[start + size - np.minimum(i, size - 1)], none) for i in range(3)]
    for n in (1, 2, 3):
        found += [_hashed(first[:n], 2 * n + 1), _hashed(last[:n], 2 * n + 2)]
        owners += [np.arange(len(words))] * 2
    listed = np.array([lexicon.get(w, -1) for w in words], np.int64)
    found.append(_hashed([listed[listed >= 0].astype(np.uint64)], 9))
    owners.append(np.flatnonzero(listed >= 0))
    every = np.concatenate(owners)
    order = np.argsort(every, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(every[order], np.arange(len(words)))


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (chains, places, labels) of padded chains, and expected label pairs summed over all."""
    chains, places, labels = scores.shape
    step = np.exp(transitions)
    local = np.exp(scores - scores.max(2, keepdims=True))
    alpha, beta = np.empty_like(local), np.empty_like(local)
    alpha[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
    for t in range(1, places):
        new = (alpha[:, t - 1] @ step) * local[:, t]
        alpha[:, t] = np.where((t < lengths)[:, None], new / new.sum(1, keepdims=True), alpha[:, t - 1])
    beta[:, -1] = 1.0 / labels
    pairs = np.zeros((labels, labels))
    for t in range(places - 2, -1, -1):
        inside = (t + 1 < lengths)[:, None]
        onward = local[:, t + 1] * beta[:, t + 1]
        new = onward @ step.T
        beta[:, t] = np.where(inside, new / new.sum(1, keepdims=True), beta[:, t + 1])
        norm = np.maximum(((alpha[:, t] @ step) * onward).sum(1, keepdims=True), 1e-300)
        pairs += ((alpha[:, t] * inside / norm).T @ onward) * step
    posterior = alpha * beta
    return posterior / posterior.sum(2, keepdims=True), pairs


class Model:
    def __init__(self, labels: list[str], lexicon: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.lexicon, self.weights, self.transitions = labels, lexicon, weights, transitions
        self.forget()

    def forget(self) -> None:
        #: Row of a token's scores (-1 without letters), and of a word's.
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.table = np.zeros((0, len(self.labels)), np.float32)

    def learn(self, tokens: set[str]) -> None:
        """Scores of tokens not met before, all at once."""
        read = {t: letters(t) for t in tokens}
        new = [w for w in dict.fromkeys(read.values()) if w and w not in self.words]
        if new:
            ids, first = features(new, self.lexicon)
            self.words.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.add.reduceat(self.weights[ids], first).astype(np.float32)])
        self.known.update((t, self.words[w] if w else -1) for t, w in read.items())

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and mean posterior of each text; a text of any length is read in stretches, and only sums of its words are kept."""
        total, size = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), np.int64)
        group: list[list[str]] = []
        owners: list[int] = []
        held = 0
        for number, text in enumerate(texts if self.labels else []):
            for part in stretches(text or ""):
                group.append(tokens(part))
                owners.append(number)
                held += len(group[-1])
                if held >= GROUP:
                    self._read(group, owners, total, size)
                    group, owners, held = [], [], 0
        self._read(group, owners, total, size)
        share = total / np.maximum(size, 1)[:, None]
        return [(self.labels[share[i].argmax()], float(min(1.0, share[i].max()))) if n else (UNKNOWN, 0.0) for i, n in enumerate(size)]

    def _read(self, group: list[list[str]], owners: list[int], total: np.ndarray, size: np.ndarray) -> None:
        """The stretches' tokens as rows of scores; what is known is forgotten before it grows too large."""
        new = set().union(*group).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.forget()
            new = set().union(*group)
        self.learn(new)
        rows = [np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)) for own in group]
        self._add([r[r >= 0] for r in rows], owners, total, size)

    def _add(self, group: list[np.ndarray], owners: list[int], total: np.ndarray, size: np.ndarray) -> None:
        """Adds the posteriors of each stretch's words, chain by chain, to its owner's sums."""
        words = np.array([len(g) for g in group], np.int64)
        if not words.sum():
            return
        np.add.at(size, owners, words)
        flat = np.concatenate(group)
        chains = -(-words // CHAIN)
        part = np.repeat(np.arange(len(group)), chains)
        number = np.arange(len(part)) - np.repeat(np.cumsum(chains) - chains, chains)
        begin = np.repeat(np.cumsum(words) - words, chains) + number * CHAIN
        lengths = np.minimum(CHAIN, words[part] - number * CHAIN)
        places = np.arange(min(CHAIN, int(lengths.max())))
        at = np.minimum(begin[:, None] + places, len(flat) - 1)
        posterior, _ = forward_backward(self.table[flat[at]], lengths, self.transitions)
        posterior *= (places < lengths[:, None])[:, :, None]
        np.add.at(total, np.array(owners)[part], posterior.sum(1))


def learn_lexicon(words: list[list[str]], labels: np.ndarray, count: int) -> dict[str, int]:
    """Words that mostly occur in one language."""
    counts = [Counter() for _ in range(count)]
    for own, label in zip(words, labels, strict=True):
        counts[label].update(own)
    total = sum(counts, Counter())
    lexicon = {}
    for label, own in enumerate(counts):
        good = [(n, w) for w, n in own.items() if n >= LEXICON_COUNT and n >= LEXICON_SHARE * total[w]]
        lexicon |= {w: label for _, w in sorted(good, key=lambda x: (-x[0], x[1]))[:LEXICON_SIZE]}
    return lexicon


def train(texts: list[str], langs: list[str], seed: int = 11) -> Model:
    """Fit weights and transitions by gradient steps on the exact likelihood."""
    labels = sorted(set(langs))
    if not labels:
        return Model([], {}, np.zeros((FEATURES, 0)), np.zeros((0, 0)))
    y = np.array([labels.index(x) for x in langs])
    words = [[w for t in tokens(text) if (w := letters(t))] for text in texts]
    lexicon = learn_lexicon(words, y, len(labels))
    rng = np.random.default_rng(seed)
    segments = [(w[i : i + SEGMENT], label) for w, label in zip(words, y, strict=True) for i in range(0, len(w) - SEGMENT + 1, SEGMENT)]
    segments += [(w, label) for w, label in zip(words, y, strict=True) if 0 < len(w) < SEGMENT]
    chosen = np.sort(rng.permutation(len(segments))[: MOST_WORDS // SEGMENT])
    moved = chosen[rng.random(len(chosen)) < MOVED]
    order = chosen.copy()
    order[np.isin(chosen, moved)] = rng.permutation(moved)
    number: dict[str, int] = {}
    chains = [[segments[i] for i in order[k : k + SEGMENTS]] for k in range(0, len(order), SEGMENTS)]
    lengths = np.array([sum(len(w) for w, _ in c) for c in chains] or [1], np.int64)
    at, want = np.zeros((len(lengths), int(lengths.max())), np.int64), np.zeros((len(lengths), int(lengths.max())), np.int64)
    for i, c in enumerate(chains):
        flat = [(number.setdefault(w, len(number)), label) for own, label in c for w in own]
        at[i, : len(flat)], want[i, : len(flat)] = zip(*flat, strict=True)
    weights, transitions = np.zeros((FEATURES, len(labels))), np.zeros((len(labels), len(labels)))
    if not number:
        return Model(labels, lexicon, weights, transitions)
    table, first = features(list(number), lexicon)
    spread = np.repeat(np.arange(len(number)), np.diff([*first, len(table)]))
    inside = np.arange(at.shape[1]) < lengths[:, None]
    gold = np.eye(len(labels))[want] * inside[:, :, None]
    both = inside[:, 1:]
    gold_pairs = np.zeros_like(transitions)
    np.add.at(gold_pairs, (want[:, :-1][both], want[:, 1:][both]), 1)
    square = [np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)]
    total = float(inside.sum())
    for _ in range(STEPS):
        scores = np.add.reduceat(weights[table], first)
        posterior, pairs = forward_backward(scores[at], lengths, transitions)
        error = (posterior * inside[:, :, None] - gold)[inside]
        to_word = np.stack([np.bincount(at[inside], error[:, k], len(number)) for k in range(len(labels))], 1)
        to_weight = np.stack([np.bincount(table, to_word[spread, k], FEATURES) for k in range(len(labels))], 1)
        for value, grad, seen in zip((weights, transitions), (to_weight / total + 1e-6 * weights, (pairs - gold_pairs) / total), square, strict=True):
            seen += grad * grad
            value -= 0.2 * grad / np.sqrt(seen)
    return Model(labels, lexicon, weights, transitions)


def fit(docs: DataFrame, folds: int = 3, held_out: int = 1, most: int = MOST_ROWS) -> Model:
    """Train on at most ``most`` rows of each language, outside the held-out fold and of at most LONGEST_TEXT code points."""
    usable = F.col("text").isNotNull() & F.col("lang").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out)
    rows = docs.select("doc_id", "text", "lang").where(usable & (F.length("text") <= LONGEST_TEXT))
    found = sampled_by(rows, "lang", most)
    return train([r.text for r in found], [r.lang for r in found])


def identify(docs: DataFrame, model: Model, folds: int = 3, held_out: int = 1, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Texts that are null or hold no letter get ``und`` and score 0, as do all
    texts if no labelled row was there to learn from; of equal mean posteriors
    the first language by name counts.  A text of any length is read whole, in
    stretches, so memory doesn't grow with it.  Repeated rows get equal
    answers; a null id hashes as empty text.  With ``carry`` all columns of
    ``docs`` come instead, then __lang and __score.  An empty table gives an
    empty result; without ``carry`` other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.labels, model.lexicon, model.weights.astype(np.float32), model.transitions.astype(np.float32)))
    fold = in_fold(docs["doc_id"], folds, held_out)
    rows = docs if carry else docs.select(docs["doc_id"].alias("doc_id"), fold.alias("held_out"), docs["text"].alias("text"))
    text_at = rows.columns.index("text")
    names = (rows.columns if carry else ["doc_id", "held_out"]) + (["__lang", "__score"] if carry else ["lang_pred", "score"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        own = in_process("language", [parts[2], parts[3]], lambda: Model(*parts))
        for batch in sliced(batches):
            found = own.predict(batch.column(text_at).to_pylist())
            kept = batch.columns if carry else [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names)

    own = [f for f in rows.schema.fields if carry or f.name != "text"]
    return rows.mapInArrow(tidy(label, "language"), T.StructType([*own, T.StructField(names[-2], T.StringType()), T.StructField(names[-1], T.DoubleType())]))
