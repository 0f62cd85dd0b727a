"""Similarity join of documents by the Jaccard similarity of their word shingles, with parity sketches.

1. A document becomes its set of shingle hashes. Each hash flips one bit of a sketch, so a bit holds the parity of the
   shingles that fall on it, and two sketches differ in at most as many bits as the sets differ in elements.
2. Sets of a similarity t differ in at most (1-t)/(1+t) of their sizes' sum. Size bands overlap so that two sets that
   can be linked share one; within a band a sketch has one 64-bit word more than elements may differ. By the pigeonhole
   principle linked sets then agree in a whole word, so rows join on (band, word number, word).
3. Sets that share a word are gathered around the least of them, and their whole sketches are compared: a forest over
   the pairs whose sketches differ in few enough bits holds every linked pair within one tree. The trees' connected
   components are candidate clusters. Equal sets are one set here, whatever the number of their copies.
4. Within a cluster sketches are compared again, nearest first, and a pair is verified on its sets unless it is in one
   component already; components join the verified links.
A gathering or cluster beyond a fixed size is dealt into blocks. Its sets are first compared with a few pivots, block by
block, then with the sets that lie closest to these, as the original of many copies does; what hangs together by then
needs no further comparison, and only the sets that stay loose meet all blocks, a pair of blocks a task. A task returns
at most one pair for each of its sets. No pair that could add a link is left out,
and none is written out for being in a group.

Shingles are 64-bit values under a key that is drawn for each run, so texts cannot be made to collide; a set's identity
is a digest of 128 bits, and links are checked on the sets themselves.

Defined cases: a text with fewer words than a shingle is one shingle; without words it has the empty set and is linked
with nothing; a null id is linked with nothing and has a null component; repeated rows have equal sets, and rows with one
id but other texts are documents of their own; texts of any length are read whole; of a component's ids the least is its
name, so there are no ties; only the id and text columns are read, so further columns cannot clash; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches, utf8_rows
from .components import components
from .words import mix, shingle_set

#: Set sizes of a band lie within this factor.
BAND = Fraction(3, 2)
#: A key that more documents have is popular.
POPULAR = 64
#: Shingles that one block of a large cluster holds, about.
BLOCK_SHINGLES = 1_000_000
#: Sets of such a block, about.
BLOCK_SETS = 2000
#: Sets of a large group that all others are compared with at first, about.
PIVOTS = 16
#: What a task gives: links (a, b); from pivots also, without b, the loose sets of its block, and with a score the set closest to the pivots.
FOUND = "grp long, a long, b long, score long"
#: Bits of the widest whole sketch.
WIDEST = 1 << 13
#: Bits of the widest maps that spare rows a shuffle; where more values are to be marked, a join does without.
FILTER_BITS = 1 << 26


def most_apart(total: int, t: Fraction) -> int:
    """The most elements by which sets of ``total`` elements in sum may differ at similarity ``t``."""
    return total - 2 * -(-total * t.numerator // (t.numerator + t.denominator))


def bands(top: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size bands."""
    ends = [1]
    while ends[-1] < top:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND)))
    return np.array(ends, dtype=np.int64)


_BANDS = bands()


def words_in(band: int, t: Fraction) -> tuple[int, int]:
    """(words of a band's sketches, spare words): two of its sets at ``t`` agree in one word more than are spare."""
    total = 2 * (int(_BANDS[band + 1]) - 1)
    apart = total * (t.denominator - t.numerator) // (t.denominator + t.numerator)
    spare = -(-apart * max(3, round(600 * float(1 - t) ** 2)) // 100) + 1 if apart else 0
    return apart + 1 + spare, spare


def bands_of(n: int, t: Fraction) -> list[int]:
    """The bands of a set of ``n``: its own, and each higher one that holds sizes it can be linked with."""
    own = int(np.searchsorted(_BANDS, n, side="right")) - 1
    out, band = [own], own + 1
    while int(_BANDS[band]) * t <= n:
        out.append(band)
        band += 1
    return out


def whole_sketch(tokens: np.ndarray) -> bytes:
    """A parity sketch of about as many bits as the set has elements: a power of two, so that it can be folded."""
    bits = min(WIDEST, max(64, 1 << max(0, len(tokens) - 1).bit_length()))
    return np.packbits((np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to ``width`` bytes: halves are joined by exclusive or, as bits are taken modulo the width."""
    rows = []
    for raw in sketches:
        words = np.frombuffer(raw, dtype=np.uint64)
        while len(words) > width // 8:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        rows.append(words)
    return np.stack(rows)


def set_id(tokens: np.ndarray) -> tuple[int, int]:
    """A set's identity of 128 bits, as two signed integers; zeros for the empty set."""
    if not len(tokens):
        return 0, 0
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def word_keys(tokens: np.ndarray, t: Fraction, popular: np.ndarray | None = None) -> np.ndarray:
    """The join keys of a set: a hash of (band, word number, word) for the words of its sketches.

    Words where no shingle falls, and those whose key many documents have (``popular``, a bit map), say little. They are left out while a band has no more of them than spare words: both properties belong to the word's
    content, so where two sets agree it is left out of both or neither, and a linked pair agrees in one that stays. A
    set with more such words gives its popular words too, and one with more empty words gives all, so that they meet.
    A word of 2**58 bits is never laid out: the exclusive or of its flipped bits' hashes stands for it.
    """
    keys = []
    for band in bands_of(len(tokens), t) if len(tokens) else []:
        n_words, spare = words_in(band, t)
        if n_words == 1:
            continue  # only equal sets can be linked, and these are one set
        h = mix(tokens + np.uint64(band))
        word = ((h >> np.uint64(32)) * np.uint64(n_words)) >> np.uint64(32)
        order = np.argsort(word, kind="stable")
        count = np.bincount(word.astype(np.int64), minlength=n_words)
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        filled = count > 0
        value = np.zeros(n_words, dtype=np.uint64)
        value[filled] = np.bitwise_xor.reduceat(mix(h)[order], begin[filled])
        place = mix(np.arange(n_words, dtype=np.uint64) + np.uint64(band << 40))
        key = mix(value ^ place) + place
        stay = np.ones(n_words, dtype=bool)
        if n_words - np.count_nonzero(filled) <= spare:
            stay = filled & ~in_bit_map(popular, key) if popular is not None else filled
            if n_words - np.count_nonzero(stay) > spare:
                stay = filled
        keys.append(key[stay])
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def set_table(texts: DataFrame, size: int, key: int = 0) -> DataFrame:
    """(doc_id, n_shingles, set_id, set_check, sketch) per document; set_id and set_check are the set's identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                rows = []
                for v in utf8_rows(part.column(1)):
                    s = shingle_set(v, size, key)
                    rows.append((len(s), *set_id(s), whole_sketch(s)))
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_shingles", "set_id", "set_check", "sketch"])

    return texts.mapInArrow(run, "doc_id long, n_shingles long, set_id long, set_check long, sketch binary")


def key_table(texts: DataFrame, size: int, t: Fraction, only: np.ndarray | None = None, popular: np.ndarray | None = None, key: int = 0) -> DataFrame:
    """(key, set_id) for the words of all sketches; equal sets give equal rows. ``only``: a bit map of the keys wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                keys, ids = [], []
                for v in utf8_rows(part.column(1)):
                    s = shingle_set(v, size, key)
                    k = word_keys(s, t, popular)
                    k = k if only is None else k[in_bit_map(only, k)]
                    if len(k):
                        keys.append(k)
                        ids.append(np.full(len(k), set_id(s)[0], dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "set_id"])

    return texts.mapInArrow(run, "key long, set_id long")


def bit_map(values: DataFrame, column: str, most_bits: int = FILTER_BITS) -> np.ndarray | None:
    """A map with the bit of each value (its low bits) set, for filters with false positives only.

    It has at least four bits a value; None where that would be more than ``most_bits``.
    """
    n = values.count()
    bits = max(1 << 20, 1 << (4 * n).bit_length())
    if bits > most_bits:
        return None
    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = values.groupBy(F.shiftright(low, 15).alias("bucket")).agg(F.bitmap_construct_agg(low.bitwiseAND(F.lit(32767))).alias("map")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["map"], dtype=np.uint8)
    return out


def in_bit_map(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = (values.view(np.int64) & (8 * len(table) - 1)).astype(np.int64)
    return ((table[low >> 3] >> (low & 7).astype(np.uint8)) & 1).astype(bool)


def popular_keys(shared: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """A map of the keys that more than ``POPULAR`` documents have, or of those of a border so much higher that they fit."""
    border = POPULAR
    while (found := bit_map(shared.filter(F.col("n") > border), "key", most_bits)) is None:
        border *= 4
    return found


def gatherings(texts: DataFrame, size: int, t: Fraction, key: int = 0) -> DataFrame:
    """Rows (set_id, hub): each set that has a word in common with others, and the least set that has this word.

    Keys are aggregated first. The few that two sets share then pick their rows through a bit map and a join, in which
    a frequent key meets a single row and can be dealt to several tasks. Popular keys, as of passages that many documents
    share, then have rows of those sets only that cannot do without.
    """
    found = key_table(texts, size, t, key=key).groupBy("key").agg(F.min("set_id").alias("hub"), F.max("set_id").alias("top"), F.count("*").alias("n")).filter("hub < top").select("key", "hub", "n")
    shared = materialize(found, "shared")
    again = key_table(texts, size, t, bit_map(shared, "key"), popular_keys(shared), key)
    return again.join(shared, "key").select("set_id", "hub").distinct()


def _place(*columns: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.greatest(F.col(blocks), F.lit(1))).cast("int")


def links_in_groups(rows: DataFrame, group: str, weight: str, most_weight: int, most_rows: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) that connect, over all groups, whatever rows of one group should be connected.

    rows: node, ``group``, ``weight`` and what ``compare`` reads; a written table. ``compare`` gets them with own, x, y, tied and held (whether the group has tied rows):
    a task (group, x, y) with x = y compares all its rows, others compare rows of different ``own`` only; it returns ``FOUND``. A
    group that fits one block is one task. Of a larger one each block meets the pivots, drawn by hash, then the sets that
    came out closest to them; what is not linked to the main ones of these is loose and meets all blocks. So rows grow with
    the number of loose rows, not with the square of the group.
    """
    need = F.greatest(F.ceil(F.sum(weight) / most_weight), F.ceil(F.count("*") / most_rows)).cast("int")
    # Written first, so that the joins below have one plain row per group and can deal a large group to several tasks.
    sizes = materialize(rows.groupBy(group).agg(need.alias("blocks"), F.count("*").alias("n")).filter("n > 1"), "blocks")
    small = rows.join(sizes.filter("blocks = 1").select(group), group).withColumns({"own": F.lit(0), "x": F.lit(0), "y": F.lit(0), "tied": F.lit(False), "held": F.lit(False)})
    found = [materialize(compare(small), "links")]
    if not sizes.filter("blocks > 1").isEmpty():
        big = rows.join(sizes.filter("blocks > 1"), group)
        state = materialize(big.select("node", group, weight, "blocks", "n", F.lit(False).alias("tied"), F.lit(False).alias("held")), "state")
        known = rows.drop(group, weight).dropDuplicates(["node"])
        drawn = state.filter(F.pmod(F.xxhash64("node"), F.col("n")) < PIVOTS)
        for turn in range(2):
            own = _place("node", blocks="blocks")
            members = state.withColumns({"own": own, "x": F.lit(-1), "y": own})
            pivots = drawn.withColumns({"own": F.lit(-1), "x": F.lit(-1), "y": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
            found.append(materialize(compare(members.unionByName(pivots).drop("blocks", "n").join(known, "node")), "links"))
            loose = found[-1].filter("b is null and score is null").select(F.col("grp").alias(group), F.col("a").alias("node")).distinct().withColumn("loose", F.lit(True))
            now = state.drop("tied").join(loose, [group, "node"], "left").withColumn("tied", F.col("loose").isNull()).drop("loose")
            left = materialize(now.groupBy(group).agg(F.count_if(~F.col("tied")).alias("loose_rows")).filter("loose_rows > 0"), "left")
            # Pivots that less than half of a group are linked to say nothing of the rest.
            held = F.col("loose_rows") * 2 < F.col("n") if not turn else F.lit(True)
            state = materialize(now.join(left, group).withColumn("held", held).withColumn("tied", F.col("tied") & F.col("held")), "state").drop("loose_rows")
            if turn or left.filter(F.col("loose_rows") > most_rows).isEmpty():
                break
            central = found[-1].filter("score is not null").select(F.col("grp").alias(group), F.col("a").alias("node"), "score").distinct()
            rank = F.row_number().over(Window.partitionBy(group).orderBy("score", "node"))
            drawn = state.join(central, [group, "node"]).withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).drop("rank", "score")
        found.append(materialize(compare(_loose_tasks(state, group, weight, most_weight, most_rows).join(known, "node")), "links"))
    edges = found[0]
    for part in found[1:]:
        edges = edges.unionByName(part)
    return edges.filter("b is not null").select("a", "b")


def _loose_tasks(state: DataFrame, group: str, weight: str, most_weight: int, most_rows: int) -> DataFrame:
    """The rows of ``state`` for the tasks that compare loose rows with each other and with tied ones."""
    loose = ~F.col("tied")
    both = [F.greatest(F.ceil(F.sum(F.when(c, F.col(weight))) / most_weight), F.ceil(F.count_if(c) / most_rows)).cast("int") for c in (loose, ~loose)]
    blocks = materialize(state.groupBy(group).agg(both[0].alias("free"), F.coalesce(both[1], F.lit(0)).alias("fast")), "blocks")
    return (
        state.drop("blocks", "n").join(blocks, group)
        .withColumn("own", F.when(loose, _place("node", blocks="free")).otherwise(F.col("free") + _place("node", blocks="fast")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(loose, F.col("free") + F.col("fast")).otherwise(F.col("free")) - 1)))
        .withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
        .drop("other", "free", "fast")
    )


def _roots(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs:
        parent[root(x)] = root(y)
    return [root(x) for x in range(n)]


def loose_rows(ids: list[int], pivot: list[bool], tied: list[bool], held: bool, links: list[tuple[int, int]], among: list[tuple[int, int]]) -> list[int]:
    """The ids of rows that are no pivots and not linked to the main pivots, by ``links`` and those ``among`` pivots.

    In a group that is ``held`` the rows tied before are linked to each other elsewhere, and main, wherever they are; in others
    the largest component of the pivots is, which is the same in every task of a group as all have the same pivots.
    """
    place: dict[int, list[int]] = {}
    for i, x in enumerate(ids):
        place.setdefault(x, []).append(i)
    same = [(v[0], i) for v in place.values() for i in v[1:]]
    before = [i for i, t in enumerate(tied) if t]
    pairs = [(place[a][0], place[b][0]) for a, b in among]
    mains = before[:1]
    if not held:
        alone = _roots(len(ids), iter(pairs))
        size: dict[int, list[int]] = {}
        for i, p in enumerate(pivot):
            if p:
                size.setdefault(alone[i], []).append(ids[i])
        mains = [place[min(max(size.values(), key=lambda v: (len(v), -min(v))))][0]] if size else []
    root = _roots(len(ids), iter([*same, *pairs, *((place[a][0], place[b][0]) for a, b in links), *((before[0], i) for i in before[1:])]))
    return [x for i, x in enumerate(ids) if not pivot[i] and (not mains or root[i] != root[mains[0]])]


def most_central(ids: list[int], sketches: list[bytes], pivot: list[bool]) -> tuple[int, int] | None:
    """(id, score): of the sets that are no pivots the one whose sketch is closest to all pivots', the least of equals."""
    mine, others = [i for i, p in enumerate(pivot) if not p], [i for i, p in enumerate(pivot) if p]
    if not mine or not others:
        return None
    rows = folded(sketches, min(map(len, sketches)))
    apart = sum(np.bitwise_count(rows[mine] ^ rows[o]).sum(axis=1, dtype=np.int64) for o in others)
    score, at = min((int(d), ids[i]) for d, i in zip(apart, mine, strict=True))
    return at, score


def compared(group: int, x: int, y: int, own: list[int], tied: list[bool], held: bool, ids: list[int], n: list[int], sketches: list[bytes], t: Fraction, sets: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """What one task finds, as rows of ``FOUND``."""
    side = None if x == y else [o == x for o in own]
    links = connecting(ids, n, sketches, t, side, sets)
    rows = [(group, a, b, None) for a, b in links]
    if x < 0:
        at = [i for i, p in enumerate(side) if p]
        pick = lambda values: [values[i] for i in at]
        among = connecting(pick(ids), pick(n), pick(sketches), t, None, pick(sets) if sets is not None else None)
        rows += [(group, a, b, None) for a, b in among]
        rows += [(group, a, None, None) for a in loose_rows(ids, side, tied, held, links, among)]
        central = most_central(ids, sketches, side)
        if central is not None:
            rows.append((group, central[0], None, central[1]))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["grp", "a", "b", "score"])


def near_edges(gathered: DataFrame, sets: DataFrame, t: Fraction, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Edges (a, b) over set_id of forests over the pairs of each gathering whose sketches are near enough to be linked."""
    known = sets.select("set_id", "n_shingles", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("hub", "x", "y")):
            first = (group[c][0] for c in ("hub", "x", "y"))
            yield compared(*first, group["own"], group["tied"], group["held"][0], group["node"], group["n_shingles"], group["sketch"], t)

    def compare(tasks: DataFrame) -> DataFrame:
        parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        whole = tasks.join(known.withColumnRenamed("set_id", "node"), "node").select("hub", "x", "y", "own", "tied", "held", "node", "n_shingles", "sketch")
        return whole.repartition(parts, "hub", "x", "y").sortWithinPartitions("hub", "x", "y", "own", "node").mapInArrow(run, FOUND)

    rows = gathered.select(F.col("set_id").alias("node"), "hub", F.lit(0).alias("weight"))
    return links_in_groups(rows, "hub", "weight", 1, block_sets, compare)


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """The runs of rows with equal ``key`` of sorted batches, as columns; a run may go over several batches."""
    held: dict[str, list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
        keys = list(zip(*(columns[k] for k in key), strict=True))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            part = {name: values[at:end] for name, values in columns.items()}
            if held is not None and tuple(held[k][0] for k in key) == keys[at]:
                for name, values in part.items():
                    held[name] += values
            else:
                if held is not None:
                    yield held
                held = part
            at = end
    if held is not None:
        yield held


def connecting(ids: list[int], n: list[int], sketches: list[bytes], t: Fraction, side: list[bool] | None = None, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs that connect whatever pairs within reach of ``t`` connect; with ``side``, of pairs of different sides only.

    Two sketches are compared at the width of the narrower one, pairs by rising Hamming distance. Without ``sets`` a
    distance that ``t`` allows is enough, with them each pair is checked on its sets unless already connected.
    """
    if len(ids) < 2:
        return []
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    allowed = np.array([most_apart(x, t) for x in range(2 * max(n) + 1)], dtype=np.int64)
    widths = np.array([len(x) for x in sketches])
    links = []
    for width in np.unique(widths):
        place = np.concatenate([np.flatnonzero(widths == width), np.flatnonzero(widths > width)])
        rows = folded([sketches[i] for i in place], int(width))
        size = np.array([n[i] for i in place], dtype=np.int64)
        own = np.array([side[i] for i in place]) if side is not None else None
        most = int(np.count_nonzero(widths == width))
        step = max(1, (1 << 22) // rows.size)
        for at in range(0, most, step):
            mine = np.arange(at, min(at + step, most))
            apart = np.bitwise_count(rows[mine, None, :] ^ rows[None, at + 1 :, :]).sum(axis=2, dtype=np.int64)
            other = np.arange(at + 1, len(place))
            a, b = size[mine, None], size[None, at + 1 :]
            near = (apart <= allowed[a + b]) & (mine[:, None] < other[None, :]) & (np.minimum(a, b) * t.denominator >= np.maximum(a, b) * t.numerator)
            if own is not None:
                near &= own[mine, None] != own[None, at + 1 :]
            i, j = np.nonzero(near)
            order = np.argsort(apart[i, j], kind="stable")
            for x, y in zip(place[mine[i[order]]].tolist(), place[other[j[order]]].tolist(), strict=True):
                rx, ry = root(x), root(y)
                if rx != ry:
                    if sets is not None:
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if both * t.denominator < t.numerator * (n[x] + n[y] - both):
                            continue
                    parent[rx] = ry
                    links.append((ids[x], ids[y]))
    return links


def links_in_clusters(texts: DataFrame, members: DataFrame, size: int, t: Fraction, block_shingles: int = BLOCK_SHINGLES, block_sets: int = BLOCK_SETS, key: int = 0) -> DataFrame:
    """Verified links (a, b) between nodes; members: node, doc_id, set_id, set_check, cluster, n_shingles, one node per set; a written table."""
    wanted = bit_map(members, "doc_id")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(in_bit_map(wanted, ids)))

    def run(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("own", "ascending"), ("node", "ascending")])
        sets = (shingle_set(v, size, key) for chunk in table.column("text").chunks for v in utf8_rows(chunk))
        found = zip(*(table.column(c).to_pylist() for c in ("own", "node", "tied", "set_id", "set_check")), sets, strict=True)
        rows = [(own, node, tied, s) for own, node, tied, *identity, s in found if set_id(s) == tuple(identity)]  # ids may repeat with other texts
        rows = [r for k, r in enumerate(rows) if not k or rows[k - 1][:2] != r[:2]]
        own, ids, tied, sets = ([r[k] for r in rows] for k in range(4))
        held = table.column("held")[0].as_py()
        made = compared(*(g.as_py() for g in group), own, tied, held, ids, [len(s) for s in sets], [whole_sketch(s) for s in sets], t, sets)
        return pa.Table.from_batches([made])

    picked = texts if wanted is None else texts.mapInArrow(pick, texts.schema)

    def compare(tasks: DataFrame) -> DataFrame:
        rows = picked.join(tasks, "doc_id").select("node", "cluster", "own", "x", "y", "tied", "held", "set_id", "set_check", "text")
        return rows.groupBy("cluster", "x", "y").applyInArrow(run, FOUND)

    return links_in_groups(members.select("node", "cluster", "n_shingles", "doc_id", "set_id", "set_check"), "cluster", "n_shingles", block_shingles, block_sets, compare)


def linked_components(docs: DataFrame, size: int = 5, t: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; component_id is the least doc_id reachable by links of at least ``t``."""
    small_batches(docs.sparkSession)
    key, same = secrets.randbits(64), ["set_id", "set_check"]
    texts = _texts(docs, id_col, text_col)
    sets = materialize(set_table(texts, size, key), "sets")
    first = sets.filter("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
    gathered = materialize(gatherings(texts, size, t, key), "gatherings")
    distinct = sets.filter("n_shingles > 0").dropDuplicates(same)
    clusters = components(near_edges(gathered, distinct, t)).withColumnsRenamed({"node": "set_id", "component": "cluster"})
    # Different sets whose first 64 bits agree have one name up to here; they are candidates too.
    alike = first.groupBy("set_id").count().filter("count > 1").select("set_id", F.col("set_id").alias("cluster"))
    clusters = clusters.unionByName(alike.join(clusters, "set_id", "left_anti"))
    members = materialize(clusters.join(first, "set_id").withColumn("node", F.monotonically_increasing_id()), "members")
    groups = components(links_in_clusters(texts, members, size, t, key=key)).withColumnRenamed("component", "grp")
    linked = members.join(groups, "node").select(*same, "doc_id", "grp")
    named = linked.groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    by_set = first.select(*same, F.col("doc_id").alias("least")).join(linked.drop("doc_id"), same, "left").join(named, "grp", "left").select(*same, "least", "component_id")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "least")).otherwise(F.col("doc_id"))
    return sets.drop("sketch").join(by_set, same, "left").select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, t: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; of rows with one id all stay."""
    found = linked_components(docs, size, t, id_col, text_col).select(F.col("doc_id").alias("_doc"), "component_id").distinct()
    kept = found.filter("component_id = _doc or _doc is null").select("_doc").distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_doc"]), "left_semi")
