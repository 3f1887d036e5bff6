"""Exact Jaccard self-join of word n-gram sets by universe partition and pigeonhole.

A text's set is its distinct word n-grams. Sets fall in bands by size. For a band, similar sets differ
in at most h tokens in all; tokens are hashed into segments, of which a share is compared for equality
(allocation 1) and a share up to one token, over one-deletion neighbourhoods (allocation 2), with
allocations that sum to h + 1 and some spare ones. By the pigeonhole principle two similar sets agree, so far, on
one segment and the spare ones, so that a set may leave segments out. Costs allocate twice: how many
segments of either kind a band has follows from the rows they index and the accidental matches they
let through; which segments a set leaves out are those beyond what its own size needs, its empty ones, then those
that most sets share.

Sets that are equal are one node. Nodes that share a segment are not paired all with all: each meets a few
centres among them, links join nodes into components, and only nodes that share a segment but are
not yet in one component meet after that, first the closest of each component. So components are those
of all links. Pairs meet by sketch: of a fixed number of groups of tokens, those with an odd count in just one
of two sets are at most as many as the tokens in which the sets differ. Who passes is compared exactly.
Keys go to buckets, whose number follows from the number of keys, as packed blocks of a few bytes a key; only keys
that two nodes or more have come out. Rows of a key that many texts of one task have are dealt to all
buckets, and only a few of them stand for it in its own.

Nulls: a null text, and one without words, has an empty set and links with nothing; a null id is
returned with a null component, and its text links only through equal sets that have an id. Texts with
fewer words than n have the sequence as their one token. Repeated rows are returned each; rows that
share an id are one node. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MIX, components, cut, drop, mix, ship, spread, table

GROWTH, PENALTY, CHUNK, WORDS, CENTRES, BITMAP = 1.5, 30.0, 400_000, 16, 3, 1 << 18
BUCKET, FLUSH, HOT = 1 << 20, 1 << 19, 64  # keys in a bucket and in a task's buffer; texts of a buffer that make a key hot
LARGE, WIDE = 1500, 256  # sets of at least LARGE tokens have a second sketch of WIDE words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = mix(np.arange(256, dtype=np.uint64) * MIX + MIX)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts that lie one after another, and where each text's words begin."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int((ends - starts).max()), 0xD6E8FEB86659FD93, np.uint64))
        mark = np.zeros(len(data), np.int64)
        mark[starts] = starts
        place = np.minimum(np.arange(len(data)) - np.maximum.accumulate(mark), len(power) - 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[_LOWER[data]] * power[place], dtype=np.uint64)])
        return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def token_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct word n-grams; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(texts).to_numpy()
    i = 0
    while i < len(sizes):
        ends = np.cumsum(sizes[i:])
        j = i + max(1, int(np.searchsorted(ends, CHUNK, "right")))
        data = np.frombuffer(b"".join(texts.slice(i, j - i).to_pylist()), np.uint8)
        words, first = word_hashes(data, np.concatenate([[0], ends[: j - i]]).astype(np.int64))
        h = mix(words + np.uint64(n)) if n > 1 else words
        for k in range(1, n):
            h = mix(h[:-1] + words[k:]) if len(h) > 1 else h[:0]
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(h[a : b - n + 1])
            elif b > a:
                yield np.array([hash_of(words[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
        i = j


def hash_of(words: np.ndarray) -> np.uint64:
    h = mix(words[:1] + np.uint64(1 << 32) + np.uint64(len(words)))
    for k in range(1, len(words)):
        h = mix(h + words[k : k + 1])
    return h[0]


@functools.lru_cache(None)
def band_starts(growth: float = GROWTH) -> np.ndarray:
    """The least size of each band."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1], int(starts[-1] * growth)) + 1)
    return np.array(starts)


def apart(size: int, percent: int) -> int:
    """In how many tokens a set of that size and a similar one differ at most."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


@functools.lru_cache(None)
def allocation(band: int, percent: int) -> tuple[int, int, int, int]:
    """(segments of allocation 2, of allocation 1, spare ones for empty segments, for costly ones) of a band; all 0: only equal sets.

    The cheapest by rows to index and accidental matches.
    """
    starts = band_starts()
    low, high = int(starts[band]), int(starts[band + 1]) - 1
    differ = apart(high, percent)
    if differ == 0:
        return 0, 0, 0, 0
    costly, best = 2 + apart(low, percent) // 10, None

    def empties(twos: int, ones: int) -> tuple[float, float]:
        """What a set's empty segments cost on the average, and with a deviation that few sets exceed."""
        filled = low / (twos + ones)
        often, spread = ((twos * (a + filled) + ones) * exp(-filled) for a in (2, 4))
        return often, often + 4 * sqrt(spread)

    for twos in {0, 1, 2, 4, (differ + costly) // 4, (differ + costly) // 2, differ // 2 + costly}:
        for spared in (False, True):
            empty = 0
            for _ in range(8 if spared else 0):
                empty = min(2 * differ + 8, ceil(empties(twos, max(1 - min(twos, 1), differ + 1 + costly + empty - 2 * twos))[1]))
            ones = max(0, differ + 1 + costly + empty - 2 * twos)
            filled = low / (twos + ones)
            often, most = empties(twos, ones)
            # Sets whose empty segments are not spared all meet by them.
            matches = exp(-1.2 * filled) * (twos + ones) + (often if most > empty else 0)
            cost = ones + twos * (1 + filled) + PENALTY * matches
            if best is None or (cost, twos) < best[:2]:
                best = cost, twos, ones, empty
    return best[1], best[2], best[3], costly


def bands_of(size: int, percent: int) -> range:
    """The bands where similar sets may meet one of that size."""
    first, last = np.searchsorted(band_starts(), [-(-size * percent // 100), size], "right") - 1
    return range(max(0, int(first)), int(last) + 1)


@functools.lru_cache(1 << 14)
def segments_of(size: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """For each of a set's bands: (band, its segments of allocation 2, of allocation 1, how many of the latter the set needs, spare for empty ones).

    A small set of a band differs in fewer tokens from similar ones, so it needs only the first segments. Of two
    similar sets the one that needs fewer still needs more than they differ in, and the other has all of those.
    """
    out = []
    for band in bands_of(size, percent):
        n2, n1, spare, costly = allocation(band, percent)
        if n1 + n2:
            need = apart(size, percent) + 1 + costly + spare - 2 * n2
            out.append((band, n2, n1, min(n1, max(0, need)), spare))
    return out


def keys_about(size: int, percent: int) -> int:
    """How many keys a set of that size has, about."""
    return sum(n2 + need + size * n2 // (n1 + n2) for _, n2, n1, need, _ in segments_of(size, percent))


def spare_of(size: int, percent: int) -> int:
    """How many costly segments a set of that size may leave out in each of its bands."""
    return min((allocation(band, percent)[3] for band, *_ in segments_of(size, percent)), default=0)


def signatures(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set's segments in every band where similar sets may meet it: of allocation 1, of allocation 2, and of one-deletion neighbours.

    A key's lowest two bits tell the band from the next ones. The keys of empty segments are left out where that
    costs no more than the band's spare: similar sets then agree on enough others. It costs 1 for an empty segment of
    allocation 1, 2 for one of allocation 2, and 1 for one of a single token, whose neighbour is empty.
    """
    ones, twos, deleted = [], [], []
    value = mix(tokens + MIX)
    for band, n2, n1, need, spare in segments_of(len(tokens), percent):
        segment = ((tokens >> np.uint64(20)) % np.uint64(n1 + n2)).astype(np.int64)
        used = segment < n2 + need
        segment, own = segment[used], value[used]
        order = np.argsort(segment, kind="stable")
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own[order], dtype=np.uint64)])
        bounds = np.searchsorted(segment[order], np.arange(n2 + need + 1))
        total = total[bounds[1:]] - total[bounds[:-1]]
        size = np.diff(bounds)
        all_ = need - np.count_nonzero(size[n2:]) + 2 * np.count_nonzero(size[:n2] == 0) + np.count_nonzero(size[:n2] == 1) > spare
        filled = (size > 0) | all_
        seed = mix(np.arange(n2 + need, dtype=np.uint64) + np.uint64((band + 1) << 40))
        as_key = lambda x, b=band: (mix(x) << np.uint64(2)) | np.uint64(b & 3)
        keys = as_key(total + seed)
        twos.append(keys[:n2][filled[:n2]])
        ones.append(keys[n2:][filled[n2:]])
        if n2:
            at = order[: bounds[n2]]
            at = at[(size[segment[at]] > 1) | all_]
            deleted.append(as_key((total + seed)[segment[at]] - own[at]))
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return joined(ones), joined(twos), joined(deleted)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.uint64).view(np.int64)))


def sketch(tokens: np.ndarray, words: int) -> np.ndarray:
    """One bit for each of 64 * words groups of tokens: whether the set holds an odd number of the group."""
    odd = np.bincount((tokens % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fingerprints(tokens: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two hashes of a set."""
    return mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(tokens + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)


def as_longs(x: list) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def digested(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, two fingerprints of the set, about how many keys it has, how many it may leave out, sketches."""
    schema = "doc_id long, n_shingles long, f1 long, f2 long, n_keys long, spare long, sketch array<long>, wide array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                sizes, f1, f2, keys, sketches, wides = [], [], [], [], [], []
                for tokens in token_sets(batch.column(1), n):
                    one, two = fingerprints(tokens)
                    sizes.append(len(tokens))
                    f1.append(one)
                    f2.append(two)
                    keys.append((keys_about(len(tokens), percent), spare_of(len(tokens), percent)))
                    sketches.append(sketch(tokens, WORDS))
                    wides.append(sketch(tokens, WIDE) if len(tokens) >= LARGE else tokens[:0])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), as_longs(f1), as_longs(f2), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(2)), lists(sketches), lists(wides)], [c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(run, schema)


BLOCKS = "bucket int, home int, state int, words binary, nodes binary"
OWN, MEMBERS, STANDINS = 0, 1, 2  # states of a block: all rows of its keys; rows of hot keys, dealt to any bucket; a few of them in their own bucket


def packed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, so that equal high bytes lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


class Buffer:
    """Keys of a task's texts, sorted and packed by bucket whenever there are FLUSH of them. A word: 28 bits of the key, 2 of the band, 2 of the kind."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.keys, self.sizes, self.kinds, self.nodes, self.total, self.seen = [], [], [], [], 0, set()

    def add(self, node: int, tokens: np.ndarray, one: np.uint64, percent: int) -> None:
        if (node, int(one)) in self.seen:
            return
        self.seen.add((node, int(one)))
        keys = signatures(tokens, percent)
        self.keys += keys
        self.sizes += map(len, keys)
        self.kinds += range(3)
        self.nodes += [node] * 3
        self.total += sum(map(len, keys))

    def blocks(self) -> Iterator[pa.RecordBatch]:
        if not self.total:
            self.clear()
            return
        keys = np.concatenate(self.keys)
        at = np.repeat(np.arange(len(self.sizes)), self.sizes)
        word = ((keys & np.uint64((1 << 30) - 1)) << np.uint64(2)) | np.array(self.kinds, np.uint64)[at]
        place = (((keys >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32)) | word
        order = np.argsort(place, kind="stable")
        place, nodes = place[order], np.array(self.nodes, np.int64)[at[order]]
        self.clear()
        # Runs of one key, of whatever kind.
        first = np.flatnonzero(np.concatenate([[True], (place[1:] >> np.uint64(2)) != (place[:-1] >> np.uint64(2))]))
        size = np.diff(np.append(first, len(place)))
        hot = np.repeat(size > HOT, size)
        standin = np.zeros(len(place), bool)
        for k in range(3):
            standin[first[size > HOT] + k] = True
        rows = [self.cut_up(place, nodes, part, state) for part, state in ((~hot, OWN), (hot, MEMBERS), (standin, STANDINS)) if part.any()]
        columns = [np.concatenate([r[i] for r in rows]) for i in range(3)]
        words, ids = ([x for r in rows for x in r[i]] for i in (3, 4))
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(words, pa.binary()), pa.array(ids, pa.binary())], [c.split()[0] for c in BLOCKS.split(", ")])

    def cut_up(self, place: np.ndarray, nodes: np.ndarray, part: np.ndarray, state: int) -> tuple:
        place, nodes = place[part], nodes[part]
        home = (place >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        if state == MEMBERS:  # long runs go to several buckets
            starts = np.union1d(starts, np.arange(0, len(home), 1 << 14))
        ends = np.append(starts[1:], len(home))
        words = [packed(place[a:b].astype(np.uint32)) for a, b in zip(starts, ends, strict=True)]
        ids = [packed(nodes[a:b]) for a, b in zip(starts, ends, strict=True)]
        bucket = home[starts]
        if state == MEMBERS:
            bucket = (mix(nodes[starts].astype(np.uint64) + MIX * place[starts]) % np.uint64(self.buckets)).astype(np.int64)
        return bucket, home[starts], np.full(len(starts), state), words, ids


def dealt(texts: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """texts (doc_id, text, skip: the first fingerprints of the id's sets that are another node's) -> BLOCKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(buckets)
        for whole in batches:
            for at in range(0, len(whole), 128):
                batch = whole.slice(at, 128)
                for node, skip, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), token_sets(batch.column(1), n), strict=True):
                    if len(tokens):
                        one = fingerprints(tokens)[0]
                        if not skip or int(one.astype(np.int64)) not in skip:
                            buffer.add(node, tokens, one, percent)
                    if buffer.total >= FLUSH:
                        yield from buffer.blocks()
        yield from buffer.blocks()

    return texts.mapInArrow(run, BLOCKS)


def meetings(blocks: DataFrame) -> DataFrame:
    """BLOCKS -> rows (key, node, kind, times) of the keys that more than two nodes have, and (a, b) of those that two have.

    times: in how many rows the key was counted at least. A key whose rows are all one-deletion neighbours is none.
    """
    schema = "key long, node long, kind int, times int, a long, b long"

    def run(group: pa.Table) -> pa.Table:
        parts = {OWN: [], MEMBERS: [], STANDINS: []}
        for home, state, words, ids in zip(*(group.column(c).to_pylist() for c in ("home", "state", "words", "nodes")), strict=True):
            word = unpacked(words, "<u4").astype(np.uint64)
            parts[state].append((np.uint64(home) << np.uint64(32) | word, unpacked(ids, "<i8")))
        here = parts[OWN] + parts[STANDINS]
        word, node = (np.concatenate([h[i] for h in here]) if here else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
        stands = np.zeros(len(word), bool)
        stands[sum(len(w) for w, _ in parts[OWN]) :] = True
        order = np.lexsort((word, node, word >> np.uint64(2)))
        word, node, stands = word[order], node[order], stands[order]
        key, kind = (word >> np.uint64(2)).astype(np.int64), (word & np.uint64(3)).astype(np.int32)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]) if len(key) else np.zeros(0, bool)
        key, node, kind, stands = key[new], node[new], kind[new], stands[new]  # the least kind of each key and node
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        least = np.minimum.reduceat(kind, first) if len(first) else kind
        stood = np.logical_or.reduceat(stands, first) if len(first) else np.zeros(0, bool)
        two = first[(size == 2) & (least < 2) & ~stood]
        many = np.repeat(stood | ((size > 2) & (least < 2)), size) & ~stands
        times = np.repeat(size, size)[many]
        rows = [(key[many], node[many], kind[many], times)]
        if parts[MEMBERS]:
            word, node_ = (np.concatenate([m[i] for m in parts[MEMBERS]]) for i in range(2))
            order = np.argsort(word >> np.uint64(2), kind="stable")
            hot = (word >> np.uint64(2)).astype(np.int64)[order]
            _, size = np.unique(hot, return_counts=True)
            rows.append((hot, node_[order], (word & np.uint64(3)).astype(np.int32)[order], np.repeat(size, size)))
        k, v, kind_, times = (np.concatenate([r[i] for r in rows]) for i in range(4))
        none = lambda m, t: pa.nulls(m, t)
        heavy = pa.table([pa.array(k), pa.array(v), pa.array(kind_.astype(np.int32)), pa.array(times.astype(np.int32)), none(len(k), pa.int64()), none(len(k), pa.int64())], names=[c.split()[0] for c in schema.split(", ")])
        light = pa.table([none(len(two), pa.int64()), none(len(two), pa.int64()), none(len(two), pa.int32()), none(len(two), pa.int32()), pa.array(node[two]), pa.array(node[two + 1])], names=heavy.column_names)
        return pa.concat_tables([heavy, light])

    return blocks.groupBy("bucket").applyInArrow(run, schema)


def with_tokens(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(list(token_sets(batch.column(1), n)))], ["node", "tokens"])

    return docs.mapInArrow(run, "node long, tokens array<long>")


def mark_held(rows: DataFrame, column: str, keys: DataFrame, held: str = "_held", words: int = BITMAP) -> DataFrame:
    """Adds held: whether the column may be among the keys (never false if it is), by a bitmap of 64 * words bits.

    At most that many words are broadcast, however many keys there are; rows are not shuffled.
    """
    slot, bit = lambda c: F.pmod(F.shiftrightunsigned(F.xxhash64(c), 6), F.lit(words)), lambda c: F.xxhash64(c).bitwiseAND(63).cast("int")
    key, mine, bits = F.col(keys.columns[0]), held + "_slot", held + "_bits"
    bitmap = keys.select(slot(key).alias(mine), F.call_function("shiftleft", F.lit(1).cast("long"), bit(key)).alias("bit")).groupBy(mine).agg(F.bit_or("bit").alias(bits))
    marked = rows.withColumn(mine, slot(F.col(column))).join(F.broadcast(bitmap), mine, "left")
    return marked.select(*rows.columns, F.coalesce(F.getbit(bits, bit(F.col(column))) == 1, F.lit(False)).alias(held))


def may_hold(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows that mark_held marks."""
    return mark_held(rows, column, keys).where("_held").drop("_held")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar, from the whole texts of the rows they name."""
    named = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = may_hold(docs.where("doc_id is not null"), "doc_id", named)
    if named.count() > 8 * BITMAP:  # too many bits are set to keep out what is not named
        texts = texts.join(named, "doc_id", "left_semi")
    sets = with_tokens(texts, n)
    both = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
    shared = F.size(F.array_intersect("s", "t"))
    return both.where(100 * shared >= percent * (F.size("s") + F.size("t") - shared)).select("a", "b").distinct()


def odd(a: str, b: str) -> Column:
    """In how many groups of tokens just one of two sketches is odd."""
    return sum((F.bit_count(F.col("s" + a)[i].bitwiseXOR(F.col("s" + b)[i])) for i in range(WORDS)), F.lit(0))




def within(differ: Column, percent: int) -> Column:
    return differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def near(percent: int) -> Column:
    """Whether sizes and sketches allow the similarity."""
    m, n = F.col("na"), F.col("nb")
    return (F.least(m, n) * 100 >= F.greatest(m, n) * percent) & within(odd("a", "b"), percent)


def near_too(pairs: DataFrame, wides: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, na, b, nb) those that the wide sketches allow, where both sets have one."""
    large = (F.col("na") >= LARGE) & (F.col("nb") >= LARGE)
    both = pairs.where(large).join(wides.toDF("a", "v"), "a").join(wides.toDF("b", "w"), "b")
    differ = F.aggregate(F.zip_with("v", "w", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return pairs.where(~large).select("a", "b").union(both.where(within(differ, percent)).select("a", "b"))


SETS = ["f1", "f2", "n_shingles"]


def met(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, ...]:
    """(small: doc_id and its set's fingerprints, classes: the least id of each set as its node, known: size and sketch of the nodes,
    wides: wide sketches of the large ones, light: pairs that alone share a key, heavy: the rows of keys that more share).
    """
    found = cut(digested(docs, n, percent))
    small = cut(found.select("doc_id", *SETS))
    classes = cut(small.where("n_shingles > 0").groupBy(*SETS).agg(F.min("doc_id").alias("node")))
    # Rows whose set has a smaller id are few; only rows that may be such are shuffled to leave them out.
    copies = cut(small.join(classes, SETS).where("doc_id <> node").select("doc_id", "f1", "f2").distinct())
    marked = mark_held(found.where("n_shingles > 0 and doc_id is not null"), "doc_id", copies.select("doc_id"))
    alone = marked.where("not _held").union(marked.where("_held").join(copies, ["doc_id", "f1", "f2"], "left_anti").select(*marked.columns))
    nodes = cut(alone.withColumnRenamed("doc_id", "node").dropDuplicates(["node", "f1", "f2"]).drop("f1", "f2", "_held"))
    known, wides = nodes.select("node", "n_shingles", "sketch"), nodes.where(F.size("wide") > 0).select("node", "wide")
    texts = mark_held(docs.where("doc_id is not null"), "doc_id", copies.select("doc_id"))
    others = copies.groupBy("doc_id").agg(F.collect_set("f1").alias("skip"))
    texts = texts.where("not _held").select("doc_id", "text", F.lit(None).cast("array<long>").alias("skip")).union(texts.where("_held").join(others, "doc_id", "left").select("doc_id", "text", "skip"))
    keys = nodes.agg(F.sum("n_keys")).first()[0] or 0
    shared = cut(meetings(dealt(texts, n, percent, max(1, -(-keys // BUCKET)))))
    light = cut(shared.where("a is not null").select("a", "b").distinct())
    heavy = shared.where("key is not null").select("key", "node", "kind", "times").join(nodes.select("node", "spare"), "node")
    costly = Window.partitionBy("node", F.col("key").bitwiseAND(3), F.col("kind") == 0).orderBy(F.desc("times"), "key")
    heavy = cut(heavy.withColumn("left_out", (F.col("kind") == 0) & (F.row_number().over(costly) <= F.col("spare"))).select("key", "node", "kind", "left_out"))
    drop(found, copies, shared)
    return small, classes, known, wides, light, heavy


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id: components of links of at least percent / 100 similarity."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    small, classes, known, wides, light, rows = met(docs, n, percent)
    about = lambda x: known.toDF(x, "n" + x, "s" + x)
    orders = [F.struct(F.xxhash64("node", F.lit(i)), "node") for i in range(CENTRES)]
    centres = rows.groupBy("key").agg(F.max(~F.col("left_out")).alias("used"), F.array(*[F.min(o)["node"] for o in orders]).alias("centres"))
    centres = cut(centres.where("used").select("key", F.array_distinct("centres").alias("c")))
    heavy = cut(spread(rows, centres, "key"))
    stars = heavy.select("node", F.explode("c").alias("c")).where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
    pairs = cut(light.union(stars).distinct().join(about("a"), "a").join(about("b"), "b").where(near(percent)).select("a", "na", "b", "nb"))
    close = cut(near_too(pairs, wides, percent).distinct())
    links = [cut(verified(close, docs, n, percent))]
    joined = components(links[0])
    drop(light, rows, centres, pairs, close)
    for closest in (True, False):
        placed = heavy.select("key", "node", "kind", "left_out").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
        open_ = cut(spread(placed, mixed, "key").join(known, "node").select("key", "node", "n_shingles", "sketch", "component", "kind", "left_out"))
        one, two = (open_.toDF("key", x, "n" + x, "s" + x, "component" + x, "kind" + x, "left_out" + x) for x in "ab")
        meet = F.expr("a < b and componenta <> componentb and not (left_outa and left_outb) and (kinda < 2 or kindb < 2)") & near(percent)
        across = one.join(two, (one["key"] == two["key"]) & meet)
        if closest:
            across = across.groupBy("a", "componentb").agg(F.min_by(F.struct("na", "b", "nb"), odd("a", "b")).alias("p")).select("a", "p.na", "p.b", "p.nb")
        pairs = cut(across.select("a", "na", "b", "nb").distinct())
        candidates = cut(near_too(pairs, wides, percent).distinct())
        more = None if candidates.isEmpty() else cut(verified(candidates, docs, n, percent))
        drop(open_, pairs, candidates)
        if more is not None and not more.isEmpty():
            links.append(more)
            drop(joined)
            joined = components(functools.reduce(DataFrame.union, links))
    drop(heavy, *links)
    labelled = classes.join(joined, "node", "left").select(*SETS, F.coalesce("component", "node").alias("component_id"))
    return small.join(labelled, SETS, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), n=3, percent=90)


ORACLE = r"""
with recursive lowered as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
split as (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from lowered),
sets as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from split),
tokens as (select doc_id, unnest(s) as token from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from tokens a join tokens b on a.token = b.token and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 90 * (len(x.s) + len(y.s) - n)),
reach(x, y) as (select doc_id, doc_id from documents union select reach.x, links.b from reach join links on reach.y = links.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, (select min(y) from reach where x = s.doc_id) as component_id from sets s
"""
