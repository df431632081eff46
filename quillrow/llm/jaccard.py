"""N-gram Jaccard join (operator 6).

Texts become sets of hashed word shingles; equal sets collapse to one class.
In one global order of the shingles, rare before common, two sets that are
similar enough share one of each other's first shingles, so classes meet only
under those.  The order counts, over the whole corpus, every shingle whose hash
falls in a fixed band; a set with enough shingles that nobody else has meets
nobody.  Under a shingle, members come in size-banded tiles: hashed bitmaps
that grow with the set bound each pair's overlap from above, and what passes
is confirmed by intersecting the exact sorted arrays.

No group's pairs are emitted: first every member meets only a few others of
its group, the same for all, confirmed links join components, and after two
such turns only pairs whose components still differ are bounded and confirmed.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import sliced
from .components import components
from .held import Remembered, held, tidy
from .carried import apart, row_hash
from .scratch import Scratch
from .skew import spread_join

SHINGLE = 5
#: Similarity in hundredths from which sets link.
PERCENT = 80
#: Documents that common shingles are fitted on at most, and how often a shingle must occur in them to count as common.
ORDER_ROWS, COMMON_COUNT, COMMON_MOST = 8000, 4, 1 << 17
#: Share of the hash range whose shingles are counted; above the share of a set that its first shingles are.
BAND = 0.3
#: Classes of so many copies that they are told to the executors, at most; only one copy of these counts its shingles.
HOT_CLASSES, FEW_COPIES = 1 << 16, 8
#: Bits of a signature: so many a shingle, at least.
BITS_SHARE, LEAST_BITS = 8, 512
#: Members of each group that all of it meets, turn by turn, before what is left of the group is compared in tiles.
HEADS = (1, 16)
#: Members of a tile, and shingles of all of them together that a tile holds about.
TILE, TILE_SHINGLES = 512, 1 << 21
#: Words remembered in a worker, and bytes of a text that are split into words at a time.
MEMORY, STRETCH = 200_000, 1 << 20
WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text at ASCII white space, A-Z lower-cased; read in stretches."""
    known = held("words", lambda: Remembered(xxhash.xxh3_64_intdigest, MEMORY))
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        gap = WHITE.search(text, at + STRETCH)
        end = gap.start() if gap else len(text)
        words = text[at:end].lower().split()
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text; bytes split at ASCII white space and lower-case A-Z only."""
    hashed = word_hashes(text or b"")
    if not len(hashed):
        return hashed
    with np.errstate(over="ignore"):
        if len(hashed) < size:
            total = np.uint64(len(hashed))
            for h in hashed:
                total = _mix(total + h) * ODD[0]
            return np.array([total], np.uint64)
        count = len(hashed) - size + 1
        total = np.zeros(count, np.uint64)
        for i in range(size):
            total = _mix(total + hashed[i : i + count]) * ODD[i % len(ODD)]
    return np.unique(_mix(total))


def needed(count, percent: int):
    """How many first shingles of a set of ``count`` every similar set must meet one of."""
    return count + (-percent * count) // 100 + 1


def banded(own: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that are counted, and those that follow them in order as far as they are needed.

    Counted ones stand first, in the order of their counts; then come those
    outside the band and last the common ones, both by hash.
    """
    late = np.zeros(len(own), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
    counted = ~late & (own < np.uint64(int(BAND * 2.0**64)))
    lacking = max(0, needed(len(own), percent) - int(counted.sum()))
    return own[counted], np.concatenate([own[~late & ~counted], own[late]])[:lacking]


def class_key(own: np.ndarray) -> bytes:
    """What tells sets apart."""
    return xxhash.xxh3_128_digest(own.tobytes())


def signature(own: np.ndarray) -> np.ndarray:
    """A bitmap of a set; more shared shingles than shared bits can't be.  It grows with the set, a power of two of bits."""
    size = max(LEAST_BITS, 1 << (BITS_SHARE * max(1, len(own)) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(own % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def folded(bits: bytes, words: int) -> np.ndarray:
    """A signature as so many 64-bit words, longer ones folded."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, words))


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits in which two signatures differ, the longer folded to the shorter's length."""
    short = min(len(x), len(y)) // 8
    return int(np.bitwise_count(folded(x, short) ^ folded(y, short)).sum())


def overlap_bound(sizes_a, sizes_b, differing):
    """At least the overlap of two sets: bits in which they differ are shingles they don't share."""
    return (sizes_a + sizes_b - differing) // 2


def similar(shared, size_a, size_b, percent: int):
    return 100 * shared >= percent * (size_a + size_b - shared)


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles frequent in a bounded sample; any order is right, a better one meets fewer candidates."""
    spark = docs.sparkSession
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, ORDER_ROWS / max(1, total)))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [shingles(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64) if own else [], pa.int64())], ["shingle"])

    counted = part.select(F.col("text").cast("binary")).mapInArrow(tidy(emit, "words"), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    top = counted.where(F.col("n") >= COMMON_COUNT).orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).collect()
    return np.sort(np.array([r.shingle for r in top], np.int64).view(np.uint64))


def _sets(docs: DataFrame, common, size: int, percent: int) -> DataFrame:
    """row, row_key, doc_id, n, class_key, code, counted, follow of every row; texts stay at the scan."""
    ddl = "row long, row_key long, doc_id long, n long, class_key binary, code long, counted array<bigint>, follow array<bigint>"
    names = [x.split()[0] for x in ddl.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [shingles(t, size) for t in batch.column(3).to_pylist()]
            keys = [class_key(s) for s in own]
            parts = [banded(s, common.value, percent) for s in own]
            made = [
                pa.array([len(s) for s in own], pa.int64()), pa.array(keys, pa.binary()), pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()),
                *(pa.array([p[i].view(np.int64) for p in parts], pa.list_(pa.int64())) for i in (0, 1)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names)

    return docs.select(F.monotonically_increasing_id().alias("row"), _row_key(), "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(build, "words"), ddl)


def _row_key():
    """What finds a class's row again in another reading of the table; rows that share it by chance are told apart by their class."""
    return F.xxhash64("doc_id", "text").alias("row_key")


def _classes(rows: DataFrame) -> DataFrame:
    """id, class_key, code, n, n_counted, copies and, of the row with the smallest id, no_id, doc_id, row_key of every set."""
    one = rows.where("n > 0").groupBy("class_key").agg(
        F.first("code").alias("code"), F.first("n").alias("n"), F.first(F.size("counted")).alias("n_counted"),
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_key")).alias("first"),
    )
    return one.select(F.monotonically_increasing_id().alias("id"), "class_key", "code", "n", "n_counted", "copies", "first.*")


def _first_ones(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """id, n, cap, shingle: the first shingles of every class that some other class may share.

    A counted shingle that one class alone holds can't be met, but takes its
    place among the first ones: a class with enough of these drops out, and
    the others share at most ``cap`` shingles with anybody.  Copies
    count too; of a class with very many only one row does, so that no shingle
    gathers the rows of a huge group of copies.
    """
    copies = classes.agg(F.sum("copies")).first()[0] or 0
    hot = classes.where(F.col("copies") > max(FEW_COPIES, copies // HOT_CLASSES)).select("class_key", F.col("row_key").alias("stands"))
    single = rows.where("n > 0").join(F.broadcast(hot), "class_key", "left").where("stands is null or stands = row_key")  # HOT_CLASSES rows at most

    met = single.select("code", F.explode("counted").alias("shingle"))
    group = Window.partitionBy("shingle")
    met = met.withColumns({"count": F.count(F.lit(1)).over(group), "low": F.min("code").over(group), "high": F.max("code").over(group)})
    shared = met.where("low < high").select("code", "shingle", "count").repartition("code").groupBy("code", "shingle").agg(F.min("count").alias("count"))
    known = classes.select("code", "id", "n", "n_counted", (F.col("n") + F.floor(F.col("n") * -percent / 100) + 1).alias("need"))
    own = Window.partitionBy("code", "id")
    alone = F.col("n_counted") - F.count(F.lit(1)).over(own)
    placed = shared.join(known, "code").withColumns({"alone": alone, "place": F.row_number().over(own.orderBy("count", "shingle"))})
    first = placed.where(F.col("place") + F.col("alone") <= F.col("need")).select("id", "n", (F.col("n") - F.col("alone")).alias("cap"), "shingle")
    follow = single.where(F.size("follow") > 0).select("class_key", F.explode("follow").alias("shingle")).distinct()
    return first.unionByName(follow.join(classes.select("class_key", "id", "n"), "class_key").select("id", "n", F.col("n").alias("cap"), "shingle"))


def _members(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id, n, own, bits: the sets and bitmaps of the wanted classes, made again from one row of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [shingles(t, size) for t in batch.column(0).to_pylist()]
            made = [[class_key(s) for s in own], [s.tobytes() for s in own], [signature(s).tobytes() for s in own]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in made], ["class_key", "own", "bits"])

    asked = classes.join(wanted, "id", "left_semi").select("id", "n", "class_key", "row_key")
    keys = asked.select("row_key").distinct().hint("shuffle_hash")  # the same plan at every size
    texts = docs.select(_row_key(), F.col("text").cast("binary").alias("text")).join(keys, "row_key", "left_semi")
    found = texts.select("text").mapInArrow(tidy(read, "words"), "class_key binary, own binary, bits binary").groupBy("class_key").agg(F.first("own").alias("own"), F.first("bits").alias("bits"))
    return found.join(asked.select("id", "n", "class_key"), "class_key").select("id", "n", "own", "bits")


def _bounded(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps can't rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes = [batch.column(c).to_numpy() for c in (2, 3)]
            both = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            differing = np.array([differing_bits(x, y) for x, y in both], np.int64)
            open_ = pa.array(similar(overlap_bound(*sizes, differing), *sizes, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(open_) for c in (0, 1)], ["a", "b"])

    left, right = (bits.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    both = spread_join(pairs.join(right, "b"), left, "a", "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return both.mapInArrow(tidy(check), "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                linked.append(similar(shared_count(x, y), len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    sets = sets.select("id", "own").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    left = sets.select(F.col("id").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("id").alias("b"), F.col("own").alias("own_b"))
    return spread_join(pairs.join(right, "b"), left, "a", "b").select("a", "b", "own_a", "own_b").mapInArrow(tidy(check), "a long, b long")


def _groups(members: DataFrame) -> DataFrame:
    """The members of the shingles that two classes or more share; of shingles with the same members one stays.

    A passage brings as many such shingles as it has words.  Member sets are
    told apart by their size and two sums of hashes, so no list is gathered.
    """
    marks = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"mark_{seed}") for seed in (1, 2)]
    alike = members.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), *marks).where("members > 1")
    kept = alike.groupBy("members", "mark_1", "mark_2").agg(F.min("shingle").alias("shingle")).select("shingle")
    return spread_join(members, kept, "shingle", "id")


def _heads(groups: DataFrame, turn: int) -> DataFrame:
    """shingle, heads: up to HEADS[turn] members of each group, the same ones each time."""
    order = F.xxhash64("id", F.lit(turn))
    one = groups.groupBy("shingle", F.pmod(order, F.lit(HEADS[turn])).alias("share")).agg(F.min(F.struct(order, "id", "n", "cap", "label")).alias("head"))
    return one.groupBy("shingle").agg(F.collect_list("head").alias("heads"))


def _labelled(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``groups`` with each member's component; before there are links every class is one."""
    if labels is None:
        return groups.withColumn("label", F.col("id"))
    return groups.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _star(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each group's heads with its members in other components that may link; other heads each turn."""
    mixed = rows.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
    met = spread_join(rows, _heads(rows, turn).join(mixed, "shingle"), "shingle", "id").withColumn("head", F.explode("heads"))
    shared = F.least("cap", "head.cap")
    close = (F.col("label") != F.col("head.label")) & (shared * 100 >= (F.col("n") + F.col("head.n") - shared) * percent)
    return met.where(close).select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct()


def _crossing(groups: DataFrame, bits: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of a group in different components that the bitmaps can't rule out.

    ``groups``: shingle, id, n, cap, label.  A group's heads have met all of
    it.  A group of up to TILE members is one tile.  In a larger one a cell
    has the members of one size band that lie in the group's largest
    component, or those that don't; it is cut by hash into tiles, and a tile
    meets itself and those of cells whose sizes and components allow links.
    """
    mixed = groups.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
    for turn in range(len(HEADS)):
        mixed = mixed.join(_heads(groups, turn).select("shingle", F.col("heads.id").alias(f"heads_{turn}")), "shingle")
    met = F.concat(*(f"heads_{turn}" for turn in range(len(HEADS))))
    groups = spread_join(groups, mixed.select("shingle", met.alias("heads")), "shingle", "id").where(~F.array_contains("heads", F.col("id"))).drop("heads")
    groups = scratch.keep(groups, "open")
    mixed = groups.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    mixed = scratch.keep(mixed, "mixed")
    fits = (F.col("members") <= TILE) & (F.col("all") <= TILE_SHINGLES)
    columns = ["tile", "side", "id", "cap", "label"]
    small = groups.join(mixed.where(fits).select("shingle"), "shingle").select(F.col("shingle").alias("tile"), F.lit(0).alias("side"), "id", "cap", "label")
    large = scratch.keep(spread_join(groups, mixed.where(~fits).select("shingle"), "shingle", "id"), "large")
    large = _dealt(large, percent, scratch).select(columns)
    tiles = small.unionByName(large).join(bits, "id").repartition("tile").sortWithinPartitions("tile", "side", "id")
    return tiles.select(*columns, "n", "bits").mapInArrow(tidy(_tile_pairs(percent)), "a long, b long").distinct()


def _dealt(groups: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """tile, side, id, cap, label: the members of large groups in all tiles where they meet others."""
    sizes = groups.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("most")).select("shingle", F.col("most.label").alias("main"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(max(100 / percent, 1.01))) + 1e-9).cast("int")  # similar sets lie in one band or in neighbours
    cell = (band * 2 + (F.col("label") != F.col("main")).cast("int")).alias("own")
    celled = scratch.keep(spread_join(groups, largest, "shingle", "id").select("shingle", "id", "n", "cap", "label", cell), "celled")
    holds = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_SHINGLES) / F.max("n"))))
    cells = celled.groupBy("shingle", F.col("own").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / holds).cast("int").alias("tiles"))
    beside = cells.select("shingle", F.col("cell").alias("with_cell"), F.col("tiles").alias("with_tiles"))
    apart = F.floor(F.col("with_cell") / 2) - F.floor(F.col("cell") / 2)
    mixed = (F.col("cell") % 2 == 1) | (F.col("with_cell") % 2 == 1)
    meet = cells.join(beside, "shingle").where(apart.between(0, 1) & (F.col("cell") <= F.col("with_cell")) & mixed)
    # each cell's few meetings, as either side; in a cell's meeting with itself a pair of tiles is taken once
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("cell").alias("own"), F.col("tiles").alias("own_tiles"), F.col("with_tiles").alias("other_tiles")),
                              F.struct(F.lit(1).alias("side"), F.col("with_cell").alias("own"), F.col("with_tiles").alias("own_tiles"), F.col("tiles").alias("other_tiles"))))
    meets = meet.select("shingle", "cell", "with_cell", sides.alias("s")).select("shingle", "s.own", F.struct("s.*", "cell", "with_cell").alias("meet"))
    meets = meets.groupBy("shingle", "own").agg(F.collect_list("meet").alias("meets"))
    rows = spread_join(celled, meets, ["shingle", "own"], "id").withColumn("meet", F.explode("meets"))
    own = F.pmod(F.xxhash64("id"), F.col("meet.own_tiles")).cast("int")
    same = F.col("meet.cell") == F.col("meet.with_cell")
    first = F.when(same & (F.col("meet.side") == 0), own).otherwise(0)
    last = F.when(same & (F.col("meet.side") == 1), own - 1).otherwise(F.col("meet.other_tiles") - 1)
    others = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    rows = rows.select("shingle", "id", "cap", "label", "meet", own.alias("tile_no"), F.explode(others).alias("other_no"))
    places = F.when(F.col("meet.side") == 0, F.struct(F.col("tile_no").alias("x"), F.col("other_no").alias("y"))).otherwise(F.struct(F.col("other_no").alias("x"), F.col("tile_no").alias("y")))
    tile = F.xxhash64("shingle", "meet.cell", "meet.with_cell", places["x"], places["y"])
    return rows.select(tile.alias("tile"), F.col("meet.side").alias("side"), "id", "cap", "label")


def _tile_pairs(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Goes through rows sorted by tile; a tile cut by the end of a batch waits for the next one."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        now = None
        for batch in sliced(batches, 1 << 14, 1 << 25):
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for low, high in itertools.pairwise(cuts):
                if waiting and key[low] != now:
                    yield _pairs(pa.Table.from_batches(waiting), percent)
                    waiting = []
                waiting.append(batch.slice(low, high - low))
                now = key[low]
        if waiting:
            yield _pairs(pa.Table.from_batches(waiting), percent)

    return compare


def _pairs(tile: pa.Table, percent: int) -> pa.RecordBatch:
    """The open pairs of one tile: its two sides, or its one side with itself."""
    side, ids, n, cap, label = (tile.column(c).to_numpy() for c in ("side", "id", "n", "cap", "label"))
    raw = tile.column("bits").to_pylist()
    words = min(map(len, raw)) // 8
    bits = np.stack([folded(x, words) for x in raw])
    middle = int((side == 0).sum())
    across = middle < len(side)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(middle):
        other = np.arange(middle if across else i + 1, len(side))
        near = other[(label[other] != label[i]) & similar(np.minimum(cap[other], cap[i]), n[other], n[i], percent)]
        if len(near):
            differing = np.bitwise_count(bits[near] ^ bits[i]).sum(1).astype(np.int64)
            near = near[similar(overlap_bound(n[near], n[i], differing), n[near], n[i], percent)]
            a.append(np.minimum(ids[near], ids[i]))
            b.append(np.maximum(ids[near], ids[i]))
    return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def _resolved(docs: DataFrame, size: int, percent: int) -> tuple[Scratch, DataFrame, DataFrame, DataFrame]:
    """The scratch tables, the rows, the classes, and id, label of the classes in a component with others."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    common = spark.sparkContext.broadcast(_common(texts, size))
    rows = scratch.keep(_sets(texts, common, size, percent), "all-sets")
    classes = scratch.keep(_classes(rows), "classes")
    members = scratch.keep(_first_ones(rows, classes, percent), "members")
    groups = scratch.keep(_groups(members), "groups")
    sets = scratch.keep(_members(texts, classes, groups.select("id").distinct(), size), "sets")
    bits = sets.select("id", "n", "bits")

    links = tried = labels = None
    for turn in range(len(HEADS)):
        star = _star(scratch.keep(_labelled(groups, labels), f"labelled-{turn}"), turn, percent)
        star = scratch.keep(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), f"star-{turn}")
        near = scratch.keep(_bounded(star, bits, percent), f"near-{turn}")
        new = scratch.keep(_confirm(near, sets, percent), f"links-{turn}")
        tried, links = (star, new) if tried is None else (tried.unionByName(star), links.unionByName(new))
        labels = components(links, scratch, f"labels-{turn}")

    crossing = _crossing(scratch.keep(_labelled(groups, labels), "labelled"), bits, percent, scratch)
    crossing = scratch.keep(crossing.join(tried, ["a", "b"], "left_anti"), "crossing")
    more = scratch.keep(_confirm(crossing, sets, percent), "more")
    final = components(links.unionByName(more), scratch, "final")

    return scratch, rows, classes, final


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Equal sets are one class.  A text without words has no shingle and links
    with nothing; null counts as such.  Every row stands for itself: rows that
    repeat an id with different texts each get their own text's result, and
    rows without id take part like all others.  The component's smallest id
    names it; a component without any id gets null.  A text of any length is
    read whole, in stretches.  An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    scratch, rows, classes, final = _resolved(docs, size, percent)
    ids = final.join(classes.select("id", "doc_id"), "id").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = final.join(ids, "label").select("id", "component_id")
    named = classes.join(linked.withColumn("linked", F.lit(True)), "id", "left")
    named = scratch.keep(named.select("class_key", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "named")
    narrow = scratch.keep(rows.select("row", "doc_id", "n", "class_key"), "rows")
    scratch.discard_but("named", "rows")
    full = spread_join(narrow.where("n > 0"), named, "class_key", "row")
    bare = narrow.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n", "component_id").unionByName(bare).withColumnRenamed("n", "n_shingles")


def keep_one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates, all columns as they are.

    Of each component the row with the smallest id stays, a row without id only
    where none has one; of rows repeated in full one stays.  Texts without
    words stay, each row of them.  Of rows with equal id and text the one whose
    hash of all columns is smallest stays.  Extra columns may have any name and
    type.  An empty table gives an empty result.
    """
    docs, restore = apart(docs, ("doc_id", "text"))
    scratch, rows, classes, final = _resolved(docs, size, percent)
    best = F.min(F.struct("no_id", "doc_id", "row_key")).alias("best")
    stays = classes.join(final, "id", "left").groupBy(F.coalesce("label", "id")).agg(best).select("best.row_key")
    often = rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("__often"))
    stays = scratch.keep(stays.distinct().join(often, "row_key").withColumnRenamed("row_key", "__key"), "stays")
    scratch.discard_but("stays")
    worded = F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    bare = docs.where(~worded)
    kept = docs.where(worded).withColumn("__key", F.xxhash64("doc_id", "text")).join(stays, "__key")
    once = kept.where("__often = 1").select(docs.columns)
    same = ["__key", F.col("doc_id").alias("__same_id"), F.xxhash64("text", F.lit(1)).alias("__same_text")]
    many = kept.where("__often > 1").groupBy(*same).agg(F.min_by(F.struct(*docs.columns), row_hash(docs)).alias("__row")).select("__row.*")
    return restore(once.unionByName(many).unionByName(bare))
