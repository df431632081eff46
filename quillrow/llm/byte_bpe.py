"""Byte-level BPE encoding and decoding (operator 7).

Texts up to CHUNK code points are one chunk, pre-tokenised and encoded where
they are read.  Longer ones become overlapping chunks that tasks pre-tokenise and
encode apart; at each seam the chunk sequences are stitched at the first
pre-token boundary both agree on, and where an overlap holds none the text
between is pre-tokenised again.  Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import sliced
from .held import LONGEST_KEY, held, tidy

#: Code points of a chunk, and how far it reads into the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Matches at the end of a cut chunk that more text could change.
UNSURE = 2
#: Bytes of texts, or of ids, that are Python objects at the same time.
SLICE = 1 << 20
#: Pre-tokens remembered in a worker.
MEMORY = 250_000
#: Bytes of a pre-token up to which pairs are scanned and not kept in a heap; above every rank.
SHORT, NEVER = 48, 1 << 60

# Code points that the installed regex module takes for letters or
# numbers and the tokenizer library, with its older Unicode tables, does not.
YOUNG = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


class Splitter:
    """The pre-tokenising pattern; white space is Unicode's White_Space."""

    def __init__(self, pattern: str):
        plain = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.usual = regex.compile(plain)
        self.young = regex.compile(f"[{YOUNG}]")
        strict = plain.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{YOUNG}])")
        strict = regex.sub(r"\\p\{[LN]\}(?!\\|\])", lambda m: rf"(?:(?![{YOUNG}]){m[0]})", strict)
        self.strict = regex.compile(strict)

    def _has_young(self, text: str) -> bool:
        if text.isascii():
            return False
        try:
            text.encode("latin-1")  # the first young code point lies far above, and this tells faster
        except UnicodeEncodeError:
            return self.young.search(text) is not None
        return False

    def pieces(self, text: str) -> list[str]:
        return (self.strict if self._has_young(text) else self.usual).findall(text)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the lowest-ranked pair merges first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) <= SHORT:
        return merge_short(piece, ranks)
    end = len(piece)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    alive = [True] * end
    heap: list[tuple[int, int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < end:
            rank = ranks.get(piece[left : after[right]])
            if rank is not None:
                heapq.heappush(heap, (rank, left, right, after[right]))

    for i in range(end - 1):
        offer(i)
    while heap:
        _, left, right, stop = heapq.heappop(heap)
        if not (alive[left] and right < end and alive[right] and after[left] == right and after[right] == stop):
            continue
        alive[right] = False
        after[left] = stop
        if stop < end:
            before[stop] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [ranks[piece[i : after[i]]] for i in range(end) if alive[i]]


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a short pre-token, by scanning its few pairs."""
    known = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [known(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
    while pairs:
        lowest = min(pairs)
        if lowest == NEVER:
            break
        i = pairs.index(lowest)
        parts[i] += parts.pop(i + 1)
        pairs.pop(i)
        if i < len(pairs):
            pairs[i] = known(parts[i] + parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = known(parts[i - 1] + parts[i], NEVER)
    return [ranks[p] for p in parts]


class Encoder(dict):
    """Pre-token -> little-endian ids; remembers up to MEMORY pre-tokens."""

    def __init__(self, vocabulary: bytes, pattern: str):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.splitter = Splitter(pattern)

    def __missing__(self, piece: str) -> bytes:
        found = merge(piece.encode(), self.ranks)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONGEST_KEY:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.splitter.pieces(text)))


def encoder(vocabulary: bytes, pattern: str) -> Encoder:
    """This worker's encoder of a vocabulary."""
    return held(("byte_bpe", hash(vocabulary), pattern), lambda: Encoder(vocabulary, pattern))


def chunk_ends(pieces: list[str], start: int, last: bool) -> list[int]:
    """Ends of a chunk's sure pre-tokens, as offsets in the text."""
    ends = (start + np.cumsum([len(p) for p in pieces], dtype=np.int64)).tolist() if pieces else []
    return ends if last else ends[: max(0, len(ends) - UNSURE)]


def stitch(chunks: list[tuple[int, list[int], list[bytes]]], again: Callable[[int, int], tuple[list[int], list[bytes], bool]]) -> bytes:
    """Ids of a text from its chunks (start, ends, ids of each piece), in order.

    ``again(at, chunk)`` pre-tokenises from a true boundary on, up to what the
    numbered chunk can see; its last value says whether it saw the text's end.
    """
    out: list[bytes] = []
    at, number, skip = 0, 0, 1
    while number < len(chunks):
        start, ends, ids = chunks[number]
        before = at
        begins = [start, *ends[:-1]] if ends else []
        place = {b: i for i, b in enumerate(begins)}.get(at)
        if place is None and ends and at < ends[-1] or not ends and at >= start:
            # out of step here: go on alone until a boundary of this chunk comes up
            more_ends, more_ids, _ = again(at, number)
            known = set(begins)
            for e, x in zip(more_ends, more_ids, strict=True):
                out.append(x)
                at = e
                if at in known:
                    break
            place = {b: i for i, b in enumerate(begins)}.get(at)
        if place is not None:
            following = set()
            if number + 1 < len(chunks):
                next_start, next_ends, _ = chunks[number + 1]
                following = {next_start, *next_ends}
            for e, x in zip(ends[place:], ids[place:], strict=True):
                out.append(x)
                at = e
                if at in following:
                    break
        # one pre-token over many chunks is looked at again after twice as many each time, and always at the last
        skip = 1 if at > before else 2 * skip
        number = number + 1 if number == len(chunks) - 1 else min(number + skip, len(chunks) - 1)
    return b"".join(out)


def encode_long(text: str, model: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
    """Ids of one text by chunks, as the distributed form makes them."""
    starts = range(0, max(1, len(text)), chunk)
    parts = [cut_chunk(text[s : s + chunk + overlap], s, s + chunk + overlap >= len(text), model) for s in starts]
    return stitch(parts, retry(lambda a, b: text[a:b], len(text), [s + chunk + overlap for s in starts], model))


def cut_chunk(text: str, start: int, last: bool, model: Encoder) -> tuple[int, list[int], list[bytes]]:
    pieces = model.splitter.pieces(text)
    ends = chunk_ends(pieces, start, last)
    return start, ends, [model[p] for p in pieces[: len(ends)]]


def retry(part: Callable[[int, int], str], length: int, sights: list[int], model: Encoder):
    def again(at: int, number: int) -> tuple[list[int], list[bytes], bool]:
        last = sights[number] >= length
        _, ends, ids = cut_chunk(part(at, min(length, sights[number])), at, last, model)
        return ends, ids, last

    return again


def encode_corpus(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids: the token ids of every row of ``docs``, little-endian unsigned 32 bits.

    ``vocabulary`` is a rank file, read once on the driver; a vocabulary's size
    doesn't grow with the corpus, so it is broadcast.  Null text counts as
    empty and has no ids.  Rows stay apart even if they repeat an id; ids may
    be null.  Texts of more than ``chunk`` code points are cut and stitched, with
    the same ids as those encoded whole.  An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    short = texts.where(F.length("text") <= chunk)
    long = texts.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(ranks.value, pattern)
        for batch in sliced(batches, most=SLICE):
            ids = [model.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    number = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int")))
    cut = (
        long.withColumn("number", number)
        .select(
            "doc_id", "row", "number", F.length("text").alias("size"),
            F.substring(F.col("text"), F.col("number") * chunk + 1, F.lit(chunk + overlap)).alias("part"),
        )
        .repartition("row", "number")
    )
    layout = pa.schema(
        [("doc_id", pa.int64()), ("row", pa.int64()), ("number", pa.int32()), ("size", pa.int32()), ("part", pa.string()),
         ("ends", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.binary())]
    )

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(ranks.value, pattern)
        for batch in sliced(batches, 16):
            rows = batch.to_pylist()
            for r in rows:
                last = r["number"] * chunk + chunk + overlap >= r["size"]
                _, r["ends"], ids = cut_chunk(r["part"], r["number"] * chunk, last, model)
                r["counts"], r["ids"] = [len(x) for x in ids], b"".join(ids)
            yield pa.RecordBatch.from_pylist(rows, layout)

    def together(table: pa.Table) -> pa.Table:
        model = encoder(ranks.value, pattern)
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        chunks = []
        for r in rows:
            at = np.cumsum([0, *r["counts"]])
            chunks.append((r["number"] * chunk, r["ends"], [r["ids"][a:b] for a, b in zip(at[:-1], at[1:], strict=True)]))
        text = "".join(r["part"][:chunk] for r in rows)
        sights = [r["number"] * chunk + chunk + overlap for r in rows]
        ids = stitch(chunks, retry(lambda a, b: text[a:b], len(text), sights, model))
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "ids": pa.array([ids], pa.binary())})

    ddl = "doc_id long, row long, number int, size int, part string, ends array<int>, counts array<int>, ids binary"
    stitched = cut.mapInArrow(tidy(apart, "byte_bpe"), ddl).groupBy("row").applyInArrow(together, "doc_id long, ids binary")
    return short.mapInArrow(tidy(whole, "byte_bpe"), "doc_id long, ids binary").unionByName(stitched)


def decode_corpus(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded: the bytes of each row's tokens, joined."""
    with open(vocabulary, "rb") as file:
        ranks = encoded.sparkSession.sparkContext.broadcast(file.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.value.splitlines())}
        for batch in sliced(batches, most=SLICE):
            texts = [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(decode), "doc_id long, ids binary, decoded binary")


def digest_columns(decoded: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
