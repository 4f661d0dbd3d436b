"""SentencePiece encoding and decoding, with distinct sampled segmentations by Gumbel top-k.

A text is a path through the lattice of vocabulary pieces. The log-probability of a path is the sum of
its pieces' scores, normalised exactly by the backward sums of the lattice; the k samples are the top k
of all paths when each is perturbed by Gumbel noise, that is, k draws without replacement (Kool et al.
2019). They are found by A-star search: a node is a prefix of a path, its bound the largest perturbed
score below it, which is exact, so nodes are opened in order of their bounds. Opening a node splits its
bound among its continuations by conditional Gumbel noise; the best continuation keeps the bound, so a
path opens straight down to its end and leaves its siblings in the queue.

Noise comes from a counter-based generator keyed by document, sample, place and piece: the same row gives
the same samples, whatever batch, order or executor it meets. Units (a run of blanks with the non-blanks after
it, a line break) are lattices of their own, since no piece crosses them; all units of many documents step
through their lattices together, and a worker keeps the lattices of units it has met, up to MAX_NODES.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.blocks import mixed64, powers
from quern.llm.common import doc_texts, give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 6
#: Copies of a text whose samples are drawn together, without replacement.
MOST_COPIES = 8
#: Piece scores follow Zipf's law in the vocabulary's own order: -POWER * log(rank + SHIFT).
POWER, SHIFT = 1.0, 10.0
#: Characters of text whose lattices a worker holds at once (a longer text is taken alone).
CHUNK_CHARS = 200_000
#: Nodes of the lattices that a worker keeps between its batches (some 100 bytes each); beyond, it starts anew.
MAX_NODES = 400_000
SPACE = "▁"
#: What a piece of the vocabulary may be: a unit, or a part of one.
_UNIT = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Vocabulary:
    """Pieces of a SentencePiece model: text, score, and the ids of the single bytes."""

    def __init__(self, pieces: list[tuple[str, int]], byte_ids: list[int]):
        self.byte_ids = byte_ids
        self.text_of = {i: p.replace(SPACE, " ").encode("utf-8") for p, i in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.score = np.zeros(max(self.text_of) + 1)
        spelled = [self.text_of.get(i, b"") for i in range(len(self.score))]
        self.sizes = np.array([len(b) for b in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.octets = np.frombuffer(b"".join(spelled), np.uint8)
        first = min(self.text_of)
        for _, i in pieces:
            self.score[i] = -POWER * math.log(i - first + SHIFT)
        self.byte_score = -POWER * math.log(len(self.text_of) + SHIFT)
        #: Hashes of all beginnings of pieces, ascending, and the id of the piece that is one, or -1.
        hashes: dict[int, int] = {}
        h, n, code = np.zeros(len(pieces), np.uint64), 0, [list(map(ord, p)) for p, _ in pieces]
        at = np.arange(len(pieces))
        while len(at):
            h[at] = _roll(h[at], np.array([code[k][n] for k in at]))
            n += 1
            for k, x in zip(at, h[at].tolist()):
                hashes[x] = pieces[k][1] if len(code[k]) == n else hashes.get(x, -1)
            at = at[[len(code[k]) > n for k in at]]
        # Two hash tables: what finds its place in the first taken goes to the second, which is searched.
        found, piece = np.array(list(hashes), np.uint64), np.array(list(hashes.values()), np.int64)
        self.shift = np.uint64(64 - max(8, 4 + len(found).bit_length()))
        slot = (found >> self.shift).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.table, self.table_piece = np.zeros(1 << (64 - int(self.shift)), np.uint64), np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.table[slot[first]], self.table_piece[slot[first]] = found[first], piece[first]
        rest = np.setdiff1d(np.arange(len(found)), first)
        rest = rest[np.argsort(found[rest])]
        self.others, self.others_piece = np.append(found[rest], np.uint64(2**64 - 1)), np.append(piece[rest], -1)
        self.crowded = np.zeros(len(self.table), bool)
        self.crowded[slot[rest]] = True

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is of the beginning of a piece, and the piece that it is of, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        alive = self.table[slot] == h
        piece = np.where(alive, self.table_piece[slot], -1)
        again = np.flatnonzero(~alive & self.crowded[slot])
        if len(again):
            where = np.searchsorted(self.others, h[again])
            hit = self.others[where] == h[again]
            alive[again[hit]], piece[again[hit]] = True, self.others_piece[where[hit]]
        return alive, piece

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """Read on the driver; the pieces travel to the executors, the file need not."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        byte_ids = [i for i in ids if sp.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("the model needs byte fallback, so that every text has a path")
        plain = [(sp.id_to_piece(i), i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        # Pieces that cross a unit's bound (inner or trailing blanks) are not used; the model at hand has none.
        return cls([(p, i) for p, i in plain if _UNIT.fullmatch(p)], byte_ids)


class _Grown:
    """An array that grows at its end; capacity doubles, so adding costs what is added."""

    __slots__ = ("held", "n")

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            wider = np.zeros(max(2 * len(self.held), self.n + len(more)), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


class _Table:
    """64-bit keys with a number each, in open addressing, looked up by whole arrays."""

    def __init__(self):
        self.keys, self.numbers = _Grown(np.uint64), _Grown(np.int64)
        self._make(12)

    def _make(self, bits: int) -> None:
        self.bits, self.slots, self.at = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key (none of them 0), or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, mask = np.arange(len(keys)), np.int64((1 << self.bits) - 1)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            here = self.slots[slot]
            hit = here == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (here != 0)
            left, slot = left[on], (slot[on] + 1) & mask
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Add distinct keys that it lacks."""
        self.keys.add(keys)
        self.numbers.add(numbers)
        if 3 * self.keys.n > 1 << self.bits:
            self._make(max(12, (6 * self.keys.n).bit_length()))
            keys, numbers = self.keys.held[: self.keys.n], self.numbers.held[: self.numbers.n]
        left, mask = np.arange(len(keys)), np.int64((1 << self.bits) - 1)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = keys[left[free]]  # of several that claim a slot, one gets it
            won = self.slots[slot] == keys[left]
            self.at[slot[won]] = numbers[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & mask


class Lattices:
    """Lattices of distinct units, in flat arrays: nodes are places in a unit, edges are pieces.

    Every length of piece is tried at all places at once, by rolling hash, as long as what has been read
    is the beginning of some piece. logp is an edge's score given its node, from the backward sums; upto is
    the chance of a node's edges up to each one. A unit's lattice does not depend on the units it was built with.
    Units are told apart by a 64-bit hash (who uses them can check what comes out against the text).
    """

    def __init__(self, v: Vocabulary, max_nodes: int = MAX_NODES):
        self.v, self.max_nodes = v, max_nodes
        self.clear()

    def clear(self) -> None:
        #: Hash of a unit -> its first node.
        self.base = _Table()
        self._first, self._count, self._target, self._piece = _Grown(np.int64), _Grown(np.int32), _Grown(np.int64), _Grown(np.int32)
        self._logp, self._upto = _Grown(np.float64), _Grown(np.float64)
        self._show()

    def _show(self) -> None:
        self.first, self.count, self.target, self.piece, self.logp, self.upto = (g.held for g in (self._first, self._count, self._target, self._piece, self._logp, self._upto))

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """The first node of every unit of each text; units not met before get their lattices."""
        if self._count.n > self.max_nodes:
            self.clear()
        code, firsts, cuts = units_of(texts)
        if not len(firsts):
            return [firsts] * len(texts)
        lengths = np.diff(np.append(firsts, len(code)))
        place = np.arange(len(code)) - np.repeat(firsts, lengths)
        value = (code.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
        key = mixed64(np.add.reduceat(value, firsts) + lengths.astype(np.uint64)) | np.uint64(1)
        node = self.base.get(key)
        new = np.flatnonzero(node < 0)
        if len(new):
            fresh, at, which = np.unique(key[new], return_index=True, return_inverse=True)
            spread, _, _ = _spread(firsts[new[at]], lengths[new[at]])
            base = self._build(code[spread].astype(np.int64), lengths[new[at]])
            self.base.put(fresh, base)
            node[new] = base[which]
        return [node[a:b] for a, b in zip(cuts, cuts[1:])]

    def _build(self, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Lattices of units of these sizes, whose characters are in code; the first node of each."""
        v, nodes0, edges0 = self.v, self._count.n, self._target.n
        node = np.arange(len(code)) + np.repeat(np.arange(len(sizes)), sizes)  # one node more at the end of each unit
        base = np.cumsum(sizes + 1) - (sizes + 1)
        left = np.repeat(base + sizes, sizes) - node
        at, h, length = np.arange(len(code)), np.zeros(len(code), np.uint64), 0
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        single = np.zeros(len(code), bool)
        while len(at):
            h = _roll(h, code[at + length])
            length += 1
            alive, piece = v.look_up(h)
            whole = piece >= 0
            found.append((at[whole], piece[whole], length))
            if length == 1:
                single[at[whole]] = True
            alive &= left[at] > length
            at, h = at[alive], h[alive]
        lone = np.flatnonzero(~single)
        octets = 1 + (code[lone] > 0x7F) + (code[lone] > 0x7FF) + (code[lone] > 0xFFFF)
        nodes = len(code) + len(sizes)
        counts = np.zeros(nodes, np.int64)
        counts[node[lone]] = 1
        for places, _, _ in found:
            counts[node[places]] += 1
        first = np.cumsum(counts) - counts
        edges = int(counts.sum())
        source, target, pieces, score = np.empty(edges, np.int64), np.empty(edges, np.int64), np.empty(edges, np.int64), np.empty(edges)
        free = first.copy()
        # Long pieces, the likely ones, first.
        for places, piece, step in [*found[::-1], (lone, -code[lone] - 1, 1)]:
            here = node[places]
            slot = free[here]
            free[here] += 1
            source[slot], target[slot], pieces[slot] = here, here + step, piece
            score[slot] = v.score[piece] if places is not lone else octets * v.byte_score
        beta = np.zeros(nodes)
        most = int(left.max(initial=0))
        by_left = np.argsort(left.astype(np.uint16) if most < 1 << 16 else left, kind="stable")
        cuts = np.searchsorted(left[by_left], np.arange(1, most + 2))
        for a, b in zip(cuts, cuts[1:]):
            these = node[by_left[a:b]]
            edge, starts, of = _spread(first[these], counts[these])
            value = score[edge] + beta[target[edge]]
            top = np.maximum.reduceat(value, starts)
            beta[these] = top + np.log(np.add.reduceat(np.exp(value - top[of]), starts))
        logp = score + beta[target] - beta[source]
        # The last edge of a node takes what is left.
        upto = np.exp(logp)
        some = np.flatnonzero(counts > 1)
        for k in range(1, int(counts.max(initial=0))):
            some = some[counts[some] > k]
            upto[first[some] + k] += upto[first[some] + k - 1]
        upto[(first + counts - 1)[counts > 0]] = np.inf
        for grown, more in ((self._first, first + edges0), (self._count, counts), (self._target, target + nodes0), (self._piece, pieces), (self._logp, logp), (self._upto, upto)):
            grown.add(more)
        self._show()
        return base + nodes0

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that a uniform number chooses at each node."""
        edge = self.first[node]
        left = np.flatnonzero(u > self.upto[edge])
        while len(left):
            edge[left] += 1
            left = left[u[left] > self.upto[edge[left]]]
        return edge


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all of first[i] .. first[i] + count[i] - 1, where each i starts among them, i of each); counts above 0."""
    starts = np.cumsum(count) - count
    of = np.repeat(np.arange(len(count)), count)
    return np.repeat(first - starts, count) + np.arange(len(of)), starts, of


def _roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h + code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))


def units_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts, where each unit starts in them, where each text's units start among the units).

    Blanks are shown as U+2581. A unit is a line break, or a run of blanks and the others that follow it.
    """
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    blank, line_end = code == ord(SPACE), code == 10
    start = line_end.copy()
    start[1:] |= line_end[:-1] | (blank[1:] & ~blank[:-1])
    start[np.append(0, ends[:-1])[ends > np.append(0, ends[:-1])]] = True
    firsts = np.flatnonzero(start)
    return code, firsts, np.searchsorted(firsts, np.append(0, ends))


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mixed64(key) >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


class _Path:
    """One sampled path of a document: its units' steps in order."""

    __slots__ = ("unit", "edge", "phi", "bound")

    def __init__(self, unit: np.ndarray, edge: np.ndarray, phi: np.ndarray, bound: float):
        self.unit, self.edge, self.phi, self.bound = unit, edge, phi, bound


#: The largest Gumbel noise that _uniform's 53 bits can give.
_MOST_NOISE = 37.5


def _gumbel(key: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_uniform(key)))


def _descend(lat: Lattices, doc: np.ndarray, unit: np.ndarray, node: np.ndarray, start_phi: np.ndarray, bound: np.ndarray, key: np.ndarray, keep: int):
    """Open one path in each document from (doc, unit, node) rows, sorted by doc and unit.

    start_phi, bound, key: per document. Of a node's continuations the one that keeps the bound is drawn
    by its chance; the others' bounds are Gumbel noise about their log-probability, truncated at the
    node's bound. Returns the steps (doc, unit, edge, log-probability after it), in order, and per
    document its `keep` best siblings. Siblings whose largest possible bound is below those are not drawn.
    """
    u64 = np.uint64
    docs = len(start_phi)
    row, cur = np.arange(len(node)), node
    row_key = mixed64(key[doc] + unit.astype(u64) * u64(0x9E3779B97F4A7C15))
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(row):
        alive = lat.count[cur] > 0
        if not alive.all():
            row, cur = row[alive], cur[alive]
        if len(row):
            u = _uniform(row_key[row] + (cur - node[row]).astype(u64) * u64(0xD1B54A32D192ED03))
            edge = lat.choose(cur, u)
            taken.append((row, cur, edge))
            cur = lat.target[edge]
    if not taken:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0), [[] for _ in range(docs)]
    rows, at, edges = (np.concatenate([t[i] for t in taken]) for i in range(3))
    order = np.argsort(rows, kind="stable")  # within a row, steps came in order
    rows, at, edges = rows[order], at[order], edges[order]
    d, logp = doc[rows], lat.logp[edges]
    cuts = np.searchsorted(d, np.arange(docs + 1))
    phi = np.empty(len(logp))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # each document on its own: the same to the last bit in any batch
        np.cumsum(logp[a:b], out=phi[a:b])
        phi[a:b] += start_phi[k]
    prefix = phi - logp

    def bounds(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(step, edge, log-probability, bound) of the steps' siblings."""
        edge, _, of = _spread(lat.first[at[steps]], lat.count[at[steps]])
        step = steps[of]
        other = edge != edges[step]
        edge, step = edge[other], step[other]
        p = prefix[step] + lat.logp[edge]
        r = rows[step]
        noise = _gumbel(row_key[r] + (at[step] - node[r]).astype(u64) * u64(0xABC98388FB8FAC03) + (lat.target[edge] - at[step]).astype(u64) * u64(0x8CB92BA72F3D8DD7) + u64(1))
        return step, edge, p, -np.logaddexp(-bound[d[step]], -(p + noise))

    def best(found) -> tuple[np.ndarray, np.ndarray]:
        """Places of each document's `keep` best, and the last one's bound (-inf if there are fewer)."""
        left, of, places = found[3].copy(), d[found[0]], []
        for _ in range(keep):
            top = np.full(docs, -np.inf)
            np.maximum.at(top, of, left)
            here = np.flatnonzero((left == top[of]) & (left > -np.inf))
            _, first = np.unique(of[here], return_index=True)
            places.append(here[first])
            left[here[first]] = -np.inf
        return np.concatenate(places), top

    several = lat.count[at] > 1
    likely = several & (prefix - start_phi[d] > -8)
    found = bounds(np.flatnonzero(likely))
    places, least = best(found)
    more = np.flatnonzero(several & ~likely & (prefix + _MOST_NOISE > least[d]))
    if len(more):
        found = tuple(np.concatenate([x[places], y]) for x, y in zip(found, bounds(more)))
        places, _ = best(found)
    siblings: list[list[tuple[float, int, int, float, int]]] = [[] for _ in range(docs)]
    for step, edge, p, b in zip(*(x[places].tolist() for x in found)):
        siblings[d[step]].append((-b, int(unit[rows[step]]), edge, p, step - int(cuts[d[step]])))
    return d, unit[rows], edges, phi, siblings


def sample_segmentations(v: Vocabulary, texts: list[str], seeds: np.ndarray, samples: int) -> list[list[tuple[list[int], float, float, float]]]:
    """sample_paths() with lists for arrays."""
    return [[(p.tolist(), *rest) for p, *rest in rows] for rows in sample_paths(v, texts, seeds, samples)]


def sample_paths(v: Vocabulary, texts: list[str], seeds: np.ndarray, samples: int, lat: Lattices | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """lat: lattices kept from earlier calls. For each text, up to `samples` distinct (edges' pieces, log-probability, perturbed score, log inclusion).

    A text with fewer segmentations than `samples` gives all it has; the empty text has one, of no piece.
    The inclusion score is the chance that the path's noise reaches the first perturbed score left out
    (1 if nothing is left out): -log of it weighs a sample in estimates.
    """
    lat = lat or Lattices(v)
    starts = lat.starts(texts)
    n = len(texts)
    bound0 = _gumbel(mixed64(seeds))
    sizes = np.array([len(s) for s in starts], np.int64)
    doc = np.repeat(np.arange(n), sizes)
    unit = np.concatenate([np.arange(s) for s in sizes]) if n else np.zeros(0, np.int64)
    node = np.concatenate(starts) if n else np.zeros(0, np.int64)
    found: list[list[_Path]] = [[] for _ in range(n)]
    queues: list[list] = [[] for _ in range(n)]

    def open_paths(ids: list[int], doc, unit, node, phi, bound, heads, which: int) -> None:
        key = mixed64(seeds[ids] + np.uint64((which + 1) * 0x8CB92BA72F3D8DD7 % (1 << 64)))
        d, u, e, p, siblings = _descend(lat, doc, unit, node, phi, bound, key, samples)
        cuts = np.searchsorted(d, np.arange(len(ids) + 1))
        for k, i in enumerate(ids):
            a, b = cuts[k], cuts[k + 1]
            parts = (u[a:b], e[a:b], p[a:b])
            lead = 0
            if heads:
                lead = len(heads[k][0])
                parts = tuple(np.concatenate(x) for x in zip(heads[k], parts))
            at = len(found[i])
            found[i].append(_Path(*parts, float(bound[k])))
            for s in siblings[k]:
                heapq.heappush(queues[i], (s[0], at, s[4] + lead, s[1], s[2], s[3]))

    open_paths(list(range(n)), doc, unit, node, np.zeros(n), bound0, None, 0)
    for which in range(1, samples):
        ids, heads, rows, phi, bound = [], [], ([], [], []), [], []
        for i in range(n):
            if not queues[i]:
                continue
            neg, at, step, u, edge, p = heapq.heappop(queues[i])
            path = found[i][at]
            heads.append((np.append(path.unit[:step], u), np.append(path.edge[:step], edge), np.append(path.phi[:step], p)))
            rest = starts[i][u:].copy()
            rows[0].append(np.full(len(rest), len(ids), np.int64))
            rows[1].append(np.arange(u, u + len(rest)))
            rest[0] = lat.target[edge]
            rows[2].append(rest)
            ids.append(i)
            phi.append(p)
            bound.append(-neg)
        if not ids:
            break
        open_paths(ids, *(np.concatenate(r) for r in rows), np.array(phi), np.array(bound), heads, which)
    out = []
    for i in range(n):
        left_out = -queues[i][0][0] if queues[i] else None
        rows = []
        for path in found[i]:
            logp = float(path.phi[-1]) if len(path.phi) else 0.0
            if left_out is None:
                inclusion = 0.0
            else:
                x = logp - left_out
                inclusion = math.log(-math.expm1(-math.exp(x))) if x > -30 else x
            rows.append((lat.piece[path.edge], logp, path.bound, min(inclusion, 0.0)))
        out.append(rows)
    return out


def expanded(pieces: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary ids, how many stand for each piece): steps over a character without a piece become its bytes."""
    sizes = np.ones(len(pieces), np.int64)
    lone = np.flatnonzero(pieces < 0)
    codes, which = np.unique(-pieces[lone] - 1, return_inverse=True)
    spelled = [(SPACE if chr(c) == _STAND_IN else chr(c)).encode("utf-8", "surrogatepass") for c in codes]
    sizes[lone] = np.array([len(b) for b in spelled], np.int64)[which]
    ids = np.repeat(pieces, sizes)
    at = (np.cumsum(sizes) - sizes)[lone]
    for k, octets in enumerate(spelled):
        for n, b in enumerate(octets):
            ids[at[which == k] + n] = v.byte_ids[b]
    return ids, sizes


def piece_ids(pieces: list[int], v: Vocabulary) -> list[int]:
    return expanded(np.array(pieces, np.int64), v)[0].tolist()


#: A literal U+2581 in a text would read as a blank; it goes through the lattice as a lone surrogate,
#: which no text holds, and comes out as its own bytes.
_STAND_IN = "\udfff"


def _shown(text: str) -> str:
    if SPACE in text:
        text = text.replace(SPACE, _STAND_IN)
    return SPACE + text.replace(" ", SPACE)


def octets_of(ids: np.ndarray, v: Vocabulary) -> tuple[bytes, np.ndarray]:
    """(the bytes of all ids, joined; how many are of each)."""
    sizes = v.sizes[ids]
    starts = np.cumsum(sizes) - sizes
    return v.octets[np.repeat(v.starts[ids] - starts, sizes) + np.arange(int(sizes.sum()))].tobytes(), sizes


def decoded(ids: list[int], v: Vocabulary) -> str:
    """The text of vocabulary ids: pieces' bytes joined, without the blank put before the text."""
    text = octets_of(np.array(ids, np.int64), v)[0].decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _seed(doc_id: int | None, text: str, seed: int, part: int = 0) -> int:
    name = f"{seed}:{doc_id}" if doc_id is not None else f"{seed}::{text}"
    return xxhash.xxh64_intdigest(f"{name}/{part}" if part else name)


ENCODED = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()),
    ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_()),
])


class _Encoder:
    """Rows (doc_id, text, copies, part) to record batches, with the lattices kept between them."""

    def __init__(self, v: Vocabulary, samples: int, seed: int):
        self.v, self.samples, self.seed, self.lattices = v, samples, seed, Lattices(v)

    def encoded(self, rows: list[tuple[int | None, str, int, int]]) -> Iterator[pa.RecordBatch]:
        for copies in sorted({r[2] for r in rows}):
            own = [r for r in rows if r[2] == copies]
            seeds = np.array([_seed(i, t, self.seed, part) for i, t, _, part in own], np.uint64)
            shown, most = [_shown(t) for _, t, _, _ in own], self.samples * copies
            paths = sample_paths(self.v, shown, seeds, most, self.lattices)
            made, wrong = self._batch(own, paths)
            if wrong:
                # Two units had one hash: these texts get lattices of their own.
                for i in wrong:
                    paths[i] = sample_paths(self.v, shown[i : i + 1], seeds[i : i + 1], most)[0]
                made, _ = self._batch(own, paths)
            yield made

    def _batch(self, rows: list, paths: list) -> tuple[pa.RecordBatch, list[int]]:
        """The rows of all paths, and the texts that did not come out as they were."""
        v = self.v
        of = [i for i, got in enumerate(paths) for _ in got]
        each = [p for got in paths for p in got]
        pieces = np.concatenate([p[0] for p in each])
        ends = np.cumsum([len(p[0]) for p in each])
        ids, sizes = expanded(pieces, v)
        offsets = np.concatenate([[0], np.cumsum(sizes)[ends - 1]]).astype(np.int32)
        octets, widths = octets_of(ids, v)
        cuts = np.concatenate([[0], np.cumsum(widths)])[offsets]
        whole = [(" " + r[1]).encode("utf-8", "surrogatepass") for r in rows]
        same = [octets[a:b] == whole[i] for i, a, b in zip(of, cuts[:-1].tolist(), cuts[1:].tolist())]
        number = [rows[i][3] * MOST_COPIES * self.samples + k + 1 for i, got in enumerate(paths) for k in range(len(got))]
        made = pa.RecordBatch.from_arrays([
            pa.array([rows[i][0] for i in of], pa.int64()), pa.array(number, pa.int32()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))), *(pa.array([p[k] for p in each], pa.float64()) for k in (1, 2, 3)), pa.array(same),
        ], schema=_SCHEMA)
        return made, sorted({i for i, ok in zip(of, same) if not ok})


def encode(docs: DataFrame, model_file: str = MODEL, samples: int = SAMPLES, seed: int = SEED, by_copies: bool = False) -> DataFrame:
    """Up to `samples` rows per document: doc_id, sample (from 1, by falling perturbed score), ids, log_prob,
    perturbed, log_inclusion, round_trip (whether decoding the ids gives the text back).

    Null and empty texts have the one segmentation of the blank that precedes every text. Rows that
    repeat a doc_id share its seed; null doc_ids are seeded by the text. With by_copies, rows of one
    doc_id and text are counted and get samples apart: as many for each copy, all distinct within
    MOST_COPIES copies, further ones from a seed of their own. An empty table gives no rows; other
    columns are ignored. Whole texts are encoded, of any length.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model_file))  # as large as the model file, no more
    rows = doc_texts(docs)
    if by_copies:
        counted = rows.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
        parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / MOST_COPIES).cast("int"))))
        rows = parts.select("doc_id", "text", F.least(F.lit(MOST_COPIES), F.col("n") - F.col("part") * MOST_COPIES).cast("int").alias("copies"), "part")
    else:
        rows = rows.select("doc_id", "text", F.lit(1).alias("copies"), F.lit(0).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(vocabulary.value, samples, seed)
        held, chars = [], 0
        for x in batches:
            for doc_id, text, copies, part in zip(x.column("doc_id").to_pylist(), x.column("text"), x.column("copies").to_pylist(), x.column("part").to_pylist()):
                t = text.as_py() or ""
                held.append((doc_id, t, copies, part))
                chars += len(t)
                if chars >= CHUNK_CHARS or len(held) >= 2000:
                    yield from encoder.encoded(held)
                    held, chars = [], 0
        if held:
            yield from encoder.encoded(held)
        del encoder
        give_back()

    return rows.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """encoded's rows (any columns, with ids array<int>) with a column text. Null ids give a null text; unknown ids raise."""
    spark: SparkSession = encoded.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = [None if ids is None else decoded(ids, vocabulary.value) for ids in x.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(texts, pa.string())], names=[*x.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))
