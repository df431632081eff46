"""Word features shared by the classifiers: hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import regex
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from .held import held

#: What glues words into one token; marks belong to their letters.
GLUE = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def unglued(tokens: list[str], longest: int, piece: int, reach: int) -> list[str]:
    """The tokens, those of more than ``longest`` characters cut into words, and such words into pieces.

    A piece of ``piece`` characters reaches over into the next one, so that no n-gram of up to ``reach`` + 1 characters is lost.
    """
    if max(map(len, tokens), default=0) <= longest:
        return tokens
    out: list[str] = []
    for token in tokens:
        if len(token) <= longest:
            out.append(token)
            continue
        for word in GLUE.split(token):
            if len(word) <= longest:
                out += [word] if word else []
            else:
                out += [word[i : i + piece + reach] for i in range(0, len(word) - reach, piece)]
    return out


def ngrams(word: str, shortest: int, longest: int) -> list[str]:
    """Character n-grams of a word with its bounds marked."""
    fenced = f"<{word}>"
    return [fenced[i : i + n] for n in range(shortest, longest + 1) for i in range(len(fenced) - n + 1)]


def buckets(features: list[str], size: int) -> list[int]:
    """Numbers of features in a table of ``size`` (a power of two)."""
    return [crc32(f.encode()) & (size - 1) for f in features]


def in_process(kind: str, weights: list[np.ndarray], build: Callable[[], object]) -> object:
    """This worker's object for a model, made once."""
    return held((kind, xxhash.xxh3_64_hexdigest(b"".join(np.ascontiguousarray(w).tobytes() for w in weights))), build)


def in_fold(doc_id: Column, folds: int, held_out: int) -> Column:
    """Whether crc32 of the id's text falls in the held-out fold; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == held_out
