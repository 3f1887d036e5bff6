"""SentencePiece encoding, decoding, and sampling of segmentations without replacement.

A text's segmentations into pieces form a lattice; a segmentation's probability is proportional to the
product of its pieces' weights (exp(score) for unigram models; 1 / (1 + rank), Zipf's law, where scores are
merge ranks). Gumbel top-k: the k segmentations with the largest perturbed log-probabilities are a
sample without replacement. They are found by best-first search: the frontier holds subtrees, each with the
maximum of its perturbed log-probabilities, drawn from the subtree's total mass and truncated at the
parent's. The first path is a forward sample after backward filtering; each path leaves, at each of
its nodes, the subtree of all other edges. The best of the frontier gives the next path.

inclusion: the chance that a segmentation is among the k, given the largest value left (1 if none is left);
log_prob - log(inclusion) is its importance weight. Random numbers come from the row's key, the path's
number and the place in the text alone, so results do not depend on partitions or retries.

Lattices are built once for the distinct space-led units of a chunk of texts and walked in step. No
shuffle. Nulls: a null text gives no row; an empty one its one empty segmentation; a null id counts
as key 0 and is returned as null. Repeated rows give the same samples. A text with fewer than k
segmentations gives all of them. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, STEP, mix, ship, table

CHUNK, BITS, SPACE = 150_000, 20, "▁"


class Vocabulary:
    """A model's pieces as hash tables of code point strings."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in usable])
        ranked = bool(len(scores)) and bool((scores == np.round(scores)).all())
        weights = -np.log1p(np.minimum(-scores, n)) if ranked else scores
        self.n, self.floor = n, float(-np.log1p(n)) if ranked else float(scores.min(initial=0)) - 10
        bytes_ = [i for i in range(n) if sp.is_byte(i)]
        self.bytes = np.array(bytes_) if len(bytes_) == 256 else None
        self.unknown = sp.unk_id()
        pieces = [np.frombuffer(sp.id_to_piece(i).encode("utf-32-le"), "<u4") for i in usable]
        self.longest = max((len(p) for p in pieces), default=1)
        self.one_unit = any(SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in usable)
        known: dict[int, tuple[int, float]] = {}
        prefixes: set[int] = set()
        with np.errstate(over="ignore"):
            for p, i, w in zip(pieces, usable, weights, strict=True):
                h = np.uint64(0)
                for c in p:
                    h = h * STEP + np.uint64(c) + np.uint64(1)
                    prefixes.add(int(h))
                known[int(h)] = (i, float(w))
        # Every prefix has an entry; those that are no piece have id -1.
        self.hashes = np.array(sorted(prefixes), np.uint64)
        got = [known.get(int(h), (-1, 0.0)) for h in self.hashes]
        self.ids, self.chances = np.array([g[0] for g in got], np.int32), np.exp(np.array([g[1] for g in got]))
        # By symbol: of pieces, and behind them of signs without a piece, by their bytes.
        signs = np.arange(0x110000)
        self.weights = np.concatenate([np.zeros(n), self.floor * (1 + (signs > 0x7F) + (signs > 0x7FF) + (signs > 0xFFFF))])
        self.weights[usable] = weights
        self.head, self.next = np.full(1 << BITS, -1, np.int32), np.full(len(self.hashes), -1, np.int32)
        for k, slot in enumerate(self.slot(self.hashes)):
            self.next[k], self.head[slot] = self.head[slot], k

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> np.uint64(31))) * MIX) >> np.uint64(64 - BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        k = self.head[self.slot(h)]
        while True:
            wrong = np.flatnonzero((k >= 0) & (self.hashes[k] != h))
            if not len(wrong):
                return k
            k[wrong] = self.next[k[wrong]]

    @functools.cached_property
    def lattice(self) -> Lattice:
        return Lattice(self)

    @functools.cached_property
    def plain(self) -> bool:
        """Whether normalising only marks spaces and adds one in front."""
        probe = "  aéé ﬁ　\tb  "
        return self.model.normalize(probe).replace(" ", SPACE) == SPACE + probe.replace(" ", SPACE)


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, and so on."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


class Block:
    """All edges of distinct units: per place and edge length the symbol, and sums of the conditional probabilities.

    Per place, in logarithms: the mass of all ways to the unit's end, and the share of all edges but the likeliest.
    """

    def __init__(self, units: list[str], v: Vocabulary):
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        self.sizes = np.array([len(u) for u in units], np.int64)
        self.ends = np.cumsum(self.sizes)
        n = len(codes)
        left = np.repeat(self.ends, self.sizes) - np.arange(n)
        at, h, edges = np.arange(n), np.zeros(n, np.uint64), []
        for k in range(v.longest):
            h = h * STEP + codes[at + k] + np.uint64(1)
            found = v.find(h)
            real = np.flatnonzero(found >= 0)
            at, h, found = at[real], h[real], found[real]
            real = v.ids[found] >= 0
            edges.append((at[real], v.ids[found[real]], v.chances[found[real]]))
            on = left[at] > k + 1
            at, h = at[on], h[on]
            if not len(at):
                break
        width = max((k + 1 for k, e in enumerate(edges) if len(e[0])), default=1)
        self.symbols, chance = np.full((n, width), -1, np.int32), np.zeros((n, width))
        for k, (at, ids, w) in enumerate(edges[:width]):
            self.symbols[at, k], chance[at, k] = ids, w * np.exp(3 * k + 3)
        bare = np.flatnonzero(self.symbols[:, 0] < 0)
        spelled = np.zeros(n + 1, np.int64)
        spelled[bare + 1] = 1 + (codes[bare] > 0x7F) + (codes[bare] > 0x7FF) + (codes[bare] > 0xFFFF)
        self.symbols[bare, 0] = v.n + codes[bare].astype(np.int32)
        chance[bare, 0] = np.exp(v.floor * spelled[bare + 1] + 3)
        spelled = np.cumsum(spelled)
        self.sums, self.mass, self.others = np.zeros((n, width), np.float32), np.zeros(n), np.zeros(n)
        self.starts = self.ends - self.sizes
        # Short units with few bare signs can't run out of a double's range.
        short = (self.sizes <= 48) & (spelled[self.ends] - spelled[self.starts] <= 4)
        self.filter_short(np.flatnonzero(short), chance)
        if not short.all():
            with np.errstate(divide="ignore"):
                self.filter_long(np.flatnonzero(~short), np.log(chance) - 3 * np.arange(1, width + 1))

    def filter_short(self, units: np.ndarray, chance: np.ndarray) -> None:
        """Backward filtering in step from the units' ends; chances carry a factor for each sign, which cancels."""
        units = units[np.argsort(-self.sizes[units], kind="stable")]
        sizes, last, width = self.sizes[units], self.ends[units] - 1, chance.shape[1]
        if not len(units):
            return
        mass = np.zeros((len(units), width + int(sizes[0]) + 1))
        mass[:, width] = 1
        for left in range(1, int(sizes[0]) + 1):
            p = last[: np.searchsorted(-sizes, -left, "right")] - (left - 1)
            x = chance[p] * mass[: len(p), left : width + left][:, ::-1]
            c = np.cumsum(x, axis=1)
            mass[: len(p), width + left] = c[:, -1]
            self.sums[p] = c / c[:, -1:]
            self.mass[p] = np.log(c[:, -1]) - 3 * left
            x[np.arange(len(p)), x.argmax(1)] = 0
            with np.errstate(divide="ignore"):
                self.others[p] = np.log(x.sum(1) / c[:, -1])

    def filter_long(self, units: np.ndarray, weights: np.ndarray) -> None:
        """The same in logarithms."""
        units = units[np.argsort(-self.sizes[units], kind="stable")]
        sizes, last, (n, width) = self.sizes[units], self.ends[units] - 1, weights.shape
        total, steps = np.zeros(n + width + 1), np.arange(1, width + 1)
        for t in range(int(sizes[0]) if len(units) else 0):
            p = last[: np.searchsorted(-sizes, -t)] - t
            ahead = np.where(steps <= t + 1, np.where(steps == t + 1, 0.0, total[np.minimum(p[:, None] + steps, n)]), -np.inf)
            x = weights[p] + ahead
            top = x.max(1)
            c = np.cumsum(np.exp(x - top[:, None]), 1)
            self.mass[p] = total[p] = top + np.log(c[:, -1])
            self.sums[p] = c / c[:, -1:]
            x[np.arange(len(p)), x.argmax(1)] = -np.inf
            self.others[p] = np.logaddexp.reduce(x, axis=1) - total[p]


class Lattice:
    """The units met so far in a task, up to `limit` places: most of a chunk's units were in one before it."""

    def __init__(self, v: Vocabulary, limit: int = 1_500_000):
        self.v, self.limit = v, limit
        self.symbols, self.sums = np.full((1 << 14, 1), -1, np.int32), np.ones((1 << 14, 1), np.float32)
        self.mass = self.others = np.zeros(1 << 14)
        self.clear()

    def clear(self) -> None:
        """Forgets all units; the room stays."""
        self.index, self.places = Index(), 0
        self.starts = self.ends = np.zeros(0, np.int64)

    def numbers(self, parts: list[list[str]]) -> np.ndarray:
        """The numbers of all units of a chunk, one after another; new ones are added."""
        if self.places > self.limit:
            self.clear()
        n = sum(map(len, parts))
        out = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(parts)), np.int64, n)
        fresh, self.index.fresh = self.index.fresh, []
        if fresh:
            self.add(Block([SPACE + u.replace(" ", SPACE) for u in fresh] if self.v.plain else fresh, self.v))
        return out

    def add(self, block: Block) -> None:
        size, width = block.symbols.shape
        room, wide = max(len(self.sums), 1 << (self.places + size).bit_length()), max(width, self.sums.shape[1])
        if (room, wide) != self.sums.shape:
            for name, empty in (("symbols", -1), ("sums", 1)):
                old = getattr(self, name)
                new = np.full((room, wide), empty, old.dtype)
                new[: self.places, : old.shape[1]] = old[: self.places]
                setattr(self, name, new)
            for name in ("mass", "others"):
                setattr(self, name, np.concatenate([getattr(self, name)[: self.places], np.zeros(room - self.places)]))
        at = slice(self.places, self.places + size)
        self.symbols[at, :width], self.sums[at, :width] = block.symbols, block.sums
        self.symbols[at, width:], self.sums[at, width:] = -1, 1
        self.mass[at], self.others[at] = block.mass, block.others
        self.starts = np.concatenate([self.starts, block.starts + self.places])
        self.ends = np.concatenate([self.ends, block.ends + self.places])
        self.places += size


def uniform(key: np.ndarray, number: int, place: np.ndarray, use: int) -> np.ndarray:
    """Numbers in (0, 1) from a row's key, a path's number, a place and a use."""
    h = mix(key + np.uint64((number * 8 + use) * int(MIX) % 2**64) + place.astype(np.uint64) * STEP)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at a location, given that they do not exceed a bound."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - location)


class Paths:
    """One segmentation of each text: edges one after another, and the subtrees they leave open.

    Of an open subtree: its edge (at), which edges of its node paths have taken (mask), and its largest value.
    It is empty only when all are taken. A path opens none beyond e**-60 of the mass at its first one: a walk
    that gets there has left about e**32 others open, but for one of 10**12.
    """

    def __init__(self, sizes, symbol, node, length, occurrence, logp, bound, exists):
        self.sizes, self.symbol, self.node, self.length, self.occurrence, self.logp = sizes, symbol, node, length, occurrence, logp
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.sums = np.concatenate([[0.0], np.cumsum(logp)])
        self.total = self.sums[self.ends] - self.sums[self.starts]
        self.bound, self.exists = bound, exists

    def before(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Log-probability of what comes before an edge."""
        return self.sums[at] - self.sums[self.starts[text]]

    def open(self, skip: np.ndarray, keys: np.ndarray, base: np.ndarray, others: np.ndarray, number: int) -> None:
        """Opens the subtrees beside each text's edges but the first ones, which belong to other paths."""
        first = self.starts + skip
        last = np.minimum(self.ends, np.searchsorted(-self.sums, 60 - self.sums[first], "right"))
        count = np.maximum(last - first, 0)
        at, text = ranges(first, count), np.repeat(np.arange(len(count)), count)
        # An edge with more than half of the mass is the likeliest; 1 - its share would lose the small ones.
        taken = np.exp(self.logp[at])
        rest = np.where(taken > 0.5, others[self.node[at]], np.log1p(-np.minimum(taken, 0.5)))
        some = rest > -np.inf
        self.at, self.text = at[some], text[some]
        self.place = base[self.occurrence[self.at]] + self.node[self.at]
        self.mask = np.uint64(1) << (self.length[self.at] - 1).astype(np.uint64)
        self.value = truncated(self.before(self.at, self.text) + rest[some], self.bound[self.text], uniform(keys[self.text], number, self.place, 1))

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """The largest open value of each text, and which subtree has it."""
        out, which = np.full(len(self.sizes), -np.inf), np.zeros(len(self.sizes), np.int64)
        if len(self.at):
            first = np.flatnonzero(np.concatenate([[True], self.text[1:] != self.text[:-1]]))
            top = np.maximum.reduceat(self.value, first)
            out[self.text[first]] = top
            hit = np.flatnonzero(self.value == np.repeat(top, np.diff(np.append(first, len(self.at)))))
            which[self.text[hit][::-1]] = hit[::-1]
        return out, which


class Index(dict):
    """Numbers its keys as they are first asked for."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Sampler:
    """Samples of a chunk of texts (without nulls), by number of path."""

    def __init__(self, keys: np.ndarray, texts: list[str], v: Vocabulary, seed: int):
        self.v = v
        self.keys = mix(keys.astype(np.uint64) + np.uint64(seed) * STEP)
        parts = [self.units(t) if t else [] for t in texts]
        self.counts = np.fromiter(map(len, parts), np.int64, len(parts))
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.lattice = v.lattice
        unit = self.lattice.numbers(parts)
        self.begin, self.end = self.lattice.starts[unit], self.lattice.ends[unit]
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        size = np.cumsum(np.concatenate([[0], self.end - self.begin]))
        self.shift = size[:-1] - np.repeat(size[self.firsts[:-1]], self.counts)
        self.key_of, self.base = self.keys[self.text], self.shift - self.begin

    def units(self, text: str) -> list[str]:
        """Parts that no piece goes over: each begins with a run of spaces, of which the first is left out if normalising is plain."""
        mark = " " if self.v.plain else SPACE
        text = text if self.v.plain else self.v.model.normalize(text)
        if self.v.one_unit:
            return [text]
        parts = text.split(mark)
        if self.v.plain and "" not in parts:
            return parts
        out, lead = [], "" if self.v.plain or not parts[0] else None
        for i, p in enumerate(parts):
            if not self.v.plain:
                lead = (lead or "") + mark if i else ""
            if p:
                out.append(lead + p)
                lead = ""
            elif self.v.plain:
                lead += mark
        return out + ([lead[1:] if self.v.plain else lead] if lead else [])

    def walk(self, occurrence: np.ndarray, at: np.ndarray, number: int) -> tuple[np.ndarray, ...]:
        """Sample on from places in units to the units' ends: (occurrence, node, length, log-probability) of every edge."""
        got, count, step = [], np.zeros(len(self.text), np.int64), 0
        on = np.flatnonzero(at < self.end[occurrence])
        occurrence, at = occurrence[on], at[on]
        while len(at):
            u = uniform(self.key_of[occurrence], number, self.base[occurrence] + at, 0).astype(np.float32)
            # The last edge's sum is 1, and a length without an edge has the sum of the one before: it is never drawn.
            sums = self.lattice.sums[at]
            k = (sums >= u[:, None]).argmax(1)
            to = at + k + 1
            p = self.v.weights[self.lattice.symbols[at, k]] - self.lattice.mass[at]
            on = np.flatnonzero(to < self.end[occurrence])
            p[on] += self.lattice.mass[to[on]]
            got.append((occurrence, step, at, k + 1, np.minimum(p, 0)))
            step += 1
            count[occurrence] = step  # all that are still walking have come as far
            occurrence, at = occurrence[on], to[on]
        if not got:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
        begin = np.cumsum(count) - count
        node, length, logp = np.empty(count.sum(), np.int64), np.empty(count.sum(), np.int64), np.empty(count.sum())
        for o, step, n, k, p in got:
            where = begin[o] + step
            node[where], length[where], logp[where] = n, k, p
        return np.repeat(np.arange(len(count)), count), node, length, logp

    def chances(self, node: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Log-probabilities of all edges at places in units; -inf where a length has none."""
        symbols = self.lattice.symbols[node]
        to = node[:, None] + np.arange(1, symbols.shape[1] + 1)
        ahead = np.where(to < self.end[occurrence][:, None], self.lattice.mass[np.minimum(to, len(self.lattice.mass) - 1)], 0.0)
        return np.where(symbols >= 0, self.v.weights[symbols] + ahead - self.lattice.mass[node][:, None], -np.inf)

    def first(self) -> Paths:
        occurrence, node, length, logp = self.walk(np.arange(len(self.text)), self.begin.copy(), 1)
        sizes = np.bincount(self.text[occurrence], minlength=len(self.counts))
        bound = -np.log(-np.log(uniform(self.keys, 1, np.zeros(len(self.keys), np.int64), 2)))
        paths = Paths(sizes, self.lattice.symbols[node, length - 1], node, length, occurrence, logp, bound, np.ones(len(sizes), bool))
        paths.open(np.zeros(len(sizes), np.int64), self.keys, self.base, self.lattice.others, 1)
        return paths

    def following(self, known: list[Paths]) -> Paths:
        """The next path of each text: the best open subtree's."""
        number = len(known) + 1
        bests = [p.best() for p in known]
        values = np.array([b[0] for b in bests])
        source = values.argmax(0)
        bound = values.max(0)
        exists = np.isfinite(bound)
        n = len(self.counts)
        prefix, node, occ, edge, edge_logp = (np.zeros(n, t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64))
        for r, p in enumerate(known):
            rows = np.flatnonzero(exists & (source == r))
            if not len(rows):
                continue
            which = bests[r][1][rows]
            at = p.at[which]
            chance = self.chances(p.node[at], p.occurrence[at])
            chance[((p.mask[which][:, None] >> np.arange(chance.shape[1], dtype=np.uint64)) & np.uint64(1)) == 1] = -np.inf
            c = np.cumsum(np.exp(chance - chance.max(1, keepdims=True)), 1)
            k = (c <= uniform(self.keys[rows], number, p.place[which], 3)[:, None] * c[:, -1:]).sum(1)
            k = np.minimum(k, (c < c[:, -1:]).sum(1))
            prefix[rows], node[rows], occ[rows] = at - p.starts[rows], p.node[at], p.occurrence[at]
            edge[rows], edge_logp[rows] = k + 1, chance[np.arange(len(k)), k]
            p.mask[which] |= np.uint64(1) << k.astype(np.uint64)
            chance[np.arange(len(k)), k] = -np.inf
            rest = np.logaddexp.reduce(chance, axis=1)
            again = truncated(p.before(at, rows) + np.maximum(rest, -1e300), bound[rows], uniform(self.keys[rows], number, p.place[which], 4))
            p.value[which] = np.where(rest > -np.inf, again, -np.inf)
        rows = np.flatnonzero(exists)
        later = self.firsts[rows + 1] - occ[rows] - 1
        starts = np.concatenate([occ[rows], ranges(occ[rows] + 1, later)])
        begins = np.concatenate([node[rows] + edge[rows], self.begin[ranges(occ[rows] + 1, later)]])
        f_occ, f_node, f_length, f_logp = self.walk(starts, begins, number)
        fresh = np.bincount(self.text[f_occ], minlength=n)
        sizes = np.where(exists, prefix + 1 + fresh, 0)
        begin = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        columns = {"node": np.zeros(total, np.int64), "length": np.zeros(total, np.int64), "occurrence": np.zeros(total, np.int64), "logp": np.zeros(total)}
        for r, p in enumerate(known):
            mine = np.flatnonzero(exists & (source == r))
            to, of = ranges(begin[mine], prefix[mine]), ranges(p.starts[mine], prefix[mine])
            for c, x in columns.items():
                x[to] = getattr(p, c)[of]
        at = (begin + prefix)[rows]
        columns["node"][at], columns["length"][at], columns["occurrence"][at], columns["logp"][at] = node[rows], edge[rows], occ[rows], edge_logp[rows]
        to = ranges((begin + prefix + 1)[rows], fresh[rows])
        for c, x in (("node", f_node), ("length", f_length), ("occurrence", f_occ), ("logp", f_logp)):
            columns[c][to] = x
        paths = Paths(sizes, self.lattice.symbols[columns["node"], columns["length"] - 1], columns["node"], columns["length"], columns["occurrence"], columns["logp"], np.where(exists, bound, -np.inf), exists)
        paths.open(np.where(exists, prefix + 1, 0), self.keys, self.base, self.lattice.others, number)
        return paths

    def ids(self, paths: Paths) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text): symbols as ids, signs without a piece as their bytes or the unknown id."""
        symbol, v = paths.symbol, self.v
        bare = np.flatnonzero(symbol >= v.n)
        if not len(bare):
            return symbol, np.concatenate([[0], paths.ends])
        signs, which = np.unique(symbol[bare] - v.n, return_inverse=True)
        spelled = [v.bytes[list(chr(c).encode())] if v.bytes is not None else np.array([v.unknown]) for c in signs]
        size = np.ones(len(symbol), np.int64)
        size[bare] = np.array([len(s) for s in spelled])[which]
        ends = np.cumsum(size)
        out = np.repeat(symbol, size)
        for k, s in enumerate(spelled):
            at = (ends - size)[bare[which == k]]
            for j, b in enumerate(s):
                out[at + j] = b
        return out, np.concatenate([[0], ends])[np.concatenate([[0], paths.ends])]


def samples(keys: np.ndarray, texts: list[str], k: int, v: Vocabulary, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray, Paths, np.ndarray]]:
    """For each path number: (ids, offsets, paths, inclusion)."""
    sampler = Sampler(keys, texts, v, seed)
    known = [sampler.first()]
    for _ in range(k - 1):
        known.append(sampler.following(known))
    left = np.max([p.best()[0] for p in known], axis=0)
    return [(*sampler.ids(p), p, -np.expm1(-np.exp(np.minimum(p.total - left, 50)))) for p in known]


SAMPLES = "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, inclusion double"


def sample(docs: DataFrame, path: str, k: int = 2, seed: int = 0) -> DataFrame:
    """docs (doc_id, text) -> SAMPLES: up to k distinct segmentations of each text, best perturbed value first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (size == 0 or size + len(texts[to] or "") <= CHUNK):
                    size += len(texts[to] or "")
                    to += 1
                rows = np.array([i for i in range(at, to) if texts[i] is not None], np.int64)
                if len(rows):
                    key = ids.take(pa.array(rows)).fill_null(0).to_numpy()
                    for number, (out, offsets, paths, inclusion) in enumerate(samples(key, [texts[i] for i in rows], k, v, seed), 1):
                        there = np.flatnonzero(paths.exists)
                        whole = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out.astype(np.int32)))
                        some = pa.array(there)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[there])), pa.array(np.full(len(there), number, np.int32)), whole.take(some), pa.array(paths.total[there]), pa.array(paths.bound[there]), pa.array(inclusion[there])], ["doc_id", "rank", "ids", "log_prob", "perturbed", "inclusion"])
                at = to

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SAMPLES)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids: the model's own segmentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path).model
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            got = [ids if text is not None else None for ids, text in zip(model.encode(texts, num_threads=1), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "ids"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, ids) -> doc_id, text; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path).model
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    ship(rows.sparkSession)
    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sample(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2, seed=1)
