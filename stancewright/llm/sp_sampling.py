"""Sampled SentencePiece segmentations without replacement, and decoding.

A text is a lattice of pieces. Sampling k paths without replacement is taking the k largest of
all path log-probabilities after adding Gumbel noise to each. A perturbed A-star search
finds them without listing paths: the noisy maximum over a set of paths has a known law, so
the search starts from the set of all paths and splits sets from the top, drawing the maxima
of the parts given that of the whole.

A set that reaches the top of the queue is followed down to its best path in one go: along
it, the next piece is drawn by its share of the remaining probability, and the maximum stays
as it is. What is left beside the path at each piece joins the queue as one set, with a maximum
drawn below that of the path. The queue of a text is kept as one array per emitted path.

Texts split into atoms at blanks and line ends, which no piece spans. The lattices of the
distinct atoms of a batch are built together on arrays, those of frequent atoms are kept for the
next ones, and all draws of a batch advance in step. Noise is a hash of seed, row key, path and position, so a row's result does not depend
on the rows around it.

The published model is a byte-pair one, without probabilities. A piece is therefore weighted by
the inverse of its place in the vocabulary, as Zipf's law has it, and a byte of a
character without a piece like the last place, times exp(-BYTE_PENALTY).
"""

from __future__ import annotations

import functools
import itertools
import mmap
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancewright.llm.words import mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_PENALTY = 10.0
#: Characters of the texts that are worked on together; a longer text is a batch of its own.
BATCH_CHARS = 300_000
#: Characters of distinct atoms whose lattices a task keeps from batch to batch, some 90 bytes each.
KEPT_CHARS = 1_200_000
#: Characters of atoms whose lattices are built at once, some 500 bytes each while that lasts; a longer atom is built alone.
BUILD_CHARS = 30_000
_SPACE = "▁"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    shift = np.uint64(65 - size.bit_length())
    return ((keys.astype(np.uint64) * _GOLDEN) >> shift).astype(np.int64)


@dataclass
class Pieces:
    """Vocabulary as a trie: a hash table from (state, character) to the next state."""

    keys: np.ndarray
    states: np.ndarray
    final: np.ndarray
    weight: np.ndarray
    byte_ids: np.ndarray
    byte_weight: float
    surface: list[bytes]

    @functools.cached_property
    def surfaces(self) -> pa.Array:
        return pa.array(self.surface, pa.binary())

    @staticmethod
    def from_list(pieces: list[str], byte_ids: list[int], weights: np.ndarray | None = None) -> Pieces:
        """``pieces`` by id, blank for blank; '' for ids that are no text. ``byte_ids`` by byte."""
        places = np.array([i for i, p in enumerate(pieces) if p], np.int64)
        if weights is None:
            weights = np.zeros(len(pieces))
            weights[places] = -np.log(1.0 + np.arange(len(places)))
            total = np.log(np.exp(weights[places]).sum())
            weights[places] -= total
            byte_weight = -np.log(1.0 + len(places)) - total - BYTE_PENALTY
        else:
            byte_weight = float(weights.min()) - BYTE_PENALTY
        step: dict[int, int] = {}
        final = [-1]
        for i in places.tolist():
            if "\n" in pieces[i] or " " in pieces[i].lstrip(" "):
                raise ValueError(f"piece {pieces[i]!r} spans a blank or a line end")
            state = 0
            for character in pieces[i]:
                key = state << 21 | ord(character)
                if key not in step:
                    step[key] = len(final)
                    final.append(-1)
                state = step[key]
            final[state] = i
        size = 1 << max(4, (8 * len(step)).bit_length())
        keys, states = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        slots = _slots(np.array(list(step), np.int64), size)
        for (key, state), slot in zip(step.items(), slots.tolist()):
            while keys[slot] >= 0:
                slot = (slot + 1) % size
            keys[slot], states[slot] = key, state
        surface = [p.encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            surface[i] = bytes([b])
        return Pieces(
            keys, states, np.array(final, np.int64), weights,
            np.array(byte_ids, np.int64), byte_weight, surface,
        )

    def next_states(self, state: np.ndarray, character: np.ndarray) -> np.ndarray:
        """Where each state leads to, -1 for nowhere."""
        key = state.astype(np.int64) << 21 | character
        slot = _slots(key, len(self.keys))
        found = self.keys[slot]
        out = np.where(found == key, self.states[slot], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.states[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    @staticmethod
    def load(model_file: str = MODEL) -> Pieces:
        """Read once, on the driver; tasks get the arrays, whose size is that of the vocabulary."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        pieces = [
            "" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
            else model.id_to_piece(i).replace(_SPACE, " ")
            for i in range(model.get_piece_size())
        ]
        return Pieces.from_list(pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def decode(ids, pieces: Pieces) -> str:
    """The text of a segmentation; exact for every segmentation that ``sample`` gives."""
    text = b"".join([pieces.surface[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decode_batch(ids: pa.ListArray, pieces: Pieces) -> pa.Array:
    """``decode`` of every list, NULL for NULL."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    bounds = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    found = pc.binary_join(pa.ListArray.from_arrays(bounds, pieces.surfaces.take(ids.flatten())), b"")
    # The blank that ``sample`` sets before each text goes.
    found = pc.if_else(pc.starts_with(found, b" "), pc.binary_replace_slice(found, 0, 1, b""), found)
    try:
        text = found.cast(pa.string())
    except pa.ArrowInvalid:
        # Lists that no segmentation has.
        text = pa.array([t.decode("utf-8", "replace") for t in found.to_pylist()], pa.string())
    return pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))


def _uniform(seeds: np.ndarray, path: int, place: np.ndarray) -> np.ndarray:
    """In (0, 1), by row seed, path number and place in the row."""
    salt = np.uint64(path * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    h = mixed(seeds ^ mixed((place.astype(np.uint64) + np.uint64(1)) * _GOLDEN + salt))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _below(location, bound, u):
    """Maximum of a set of paths of log mass ``location``, given that it is below ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.log(np.exp(location - bound) - np.log(u)))


class _Grown:
    """An array that grows at its end; ``now`` is what it holds.

    It lies in memory mapped for it alone, which goes back to the system when it is outgrown or given up;
    on the heap the holes that growing leaves would stay with the worker, task after task.
    """

    def __init__(self, kind: type) -> None:
        self._kind, self._data, self._size = kind, np.empty(0, kind), 0

    def add(self, values: np.ndarray) -> None:
        size = self._size + len(values)
        if size > len(self._data):
            room = max(1 << 12, size + size // 4) * np.dtype(self._kind).itemsize
            grown = np.frombuffer(mmap.mmap(-1, room, mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS), self._kind)
            grown[: self._size] = self.now
            self._data = grown
        self._data[self._size : size] = values
        self._size = size

    def put(self, values: np.ndarray) -> None:
        self._size = 0
        self.add(values)

    @property
    def now(self) -> np.ndarray:
        return self._data[: self._size]


class Lattices:
    """Edges of the lattices of distinct atoms, by start node, with their conditional shares.

    Atoms are added batch by batch. Once there are over ``KEPT_CHARS`` characters of them, the
    next batch first drops those that were used least, down to half as many characters.

    The nodes of atoms added together are numbered by their distance to the end, ends first, and
    longer atoms first where it is equal. So the edges onward of one distance are one slice.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        # By atom, by node, and by edge.
        self._grown = {n: _Grown(np.int32) for n in ("length", "entry", "uses", "left", "owner", "low", "high", "end", "piece")}
        self._grown |= {n: _Grown(np.float64) for n in ("log_share", "upto")}
        self.index: dict[str, int] = {}
        for name in self._grown:
            self._look(name)

    def _look(self, name: str) -> None:
        setattr(self, name, self._grown[name].now)

    def numbers(self, atoms: pa.Array) -> np.ndarray:
        """The number of each atom; lattices are built for those that have none yet."""
        if len(self.left) > KEPT_CHARS:
            self._drop_rare()
        coded = atoms.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.index.get, distinct, itertools.repeat(-1)), np.int32, len(distinct))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            # Like lengths together: a build takes as many steps as its longest atom has characters.
            lengths = np.fromiter(map(len, distinct[new]), np.int64, len(new))
            like = np.argsort(-lengths, kind="stable")
            new, lengths = new[like], lengths[like]
            numbers[new] = np.arange(len(self.index), len(self.index) + len(new))
            self.index.update(zip(distinct[new], numbers[new].tolist()))
            for a, b in _ranges(lengths.tolist(), BUILD_CHARS):
                self._build(distinct[new[a:b]])
        found = numbers[coded.indices.to_numpy()]
        self.uses += np.bincount(found, minlength=len(self.index)).astype(np.int32)
        return found

    def _drop_rare(self) -> None:
        often = np.argsort(-self.uses, kind="stable")
        often = often[np.cumsum(self.length[often] + 1) <= KEPT_CHARS // 2]
        stays = np.zeros(len(self.uses), bool)
        stays[often[self.uses[often] > 1]] = True
        atoms, nodes = np.flatnonzero(stays), np.flatnonzero(stays[self.owner])
        sizes = self.high - self.low
        edges = np.flatnonzero(np.repeat(stays[self.owner], sizes))
        node, atom = np.empty(len(self.left), np.int32), np.cumsum(stays) - 1
        node[nodes] = np.arange(len(nodes))
        sizes = sizes[nodes]
        high = np.cumsum(sizes)
        # One array after the other, so that no more than one is there twice.
        left = {
            "length": lambda x: x[atoms], "entry": lambda x: node[x[atoms]], "uses": lambda x: x[atoms] // 2,
            "left": lambda x: x[nodes], "owner": lambda x: atom[x[nodes]], "low": lambda x: high - sizes, "high": lambda x: high,
            "end": lambda x: node[x[edges]], "piece": lambda x: x[edges], "log_share": lambda x: x[edges],
            "upto": lambda x: x[edges],
        }
        self.index = dict(zip(itertools.compress(self.index, stays.tolist()), itertools.count()))
        for name, grown in self._grown.items():
            grown.put(left[name](grown.now))
            self._look(name)

    def _build(self, atoms: np.ndarray) -> None:
        pieces, first_atom, first_node, first_edge = self.pieces, len(self.length), len(self.left), len(self.end)
        lengths = np.fromiter(map(len, atoms), np.int32, len(atoms))
        order = np.argsort(-lengths, kind="stable")
        text = np.frombuffer("".join(atoms[order]).encode("utf-32-le"), np.int32)
        n, longest = len(atoms), int(lengths.max())
        # By distance to the end: how many nodes, and which is the first one.
        widths = np.cumsum(np.bincount(lengths, minlength=longest + 1)[::-1])[::-1]
        level = np.append(0, np.cumsum(widths))
        n_nodes = int(level[-1])
        left = np.repeat(np.arange(longest + 1, dtype=np.int32), widths)
        node = np.arange(n_nodes, dtype=np.int32)
        rank = node - np.repeat(level[:-1].astype(np.int32), widths)
        character = np.zeros(n_nodes, np.int32)
        character[n:] = text[(np.cumsum(lengths[order], dtype=np.int32)[rank] - left)[n:]]
        # The node one character on.
        onto = node.copy()
        onto[n:] -= np.repeat(widths[:-1].astype(np.int32), widths[1:])
        at = end = node[n:]
        state, found, edges = np.zeros(len(at), np.int32), [], np.zeros(n_nodes, np.int32)
        while len(at):
            state = pieces.next_states(state, character[end])
            ok = np.flatnonzero(state >= 0)
            at, state, end = at[ok], state[ok], onto[end[ok]]
            piece = pieces.final[state]
            whole = np.flatnonzero(piece >= 0)
            where = at[whole]
            # Which edge of its node each one is; shorter pieces come first.
            number = edges[where]
            found.append((where, number, end[whole], piece[whole]))
            edges[where] = number + 1
            if len(found) == 1:
                # A character without a piece is encoded as its bytes.
                lone = n + np.flatnonzero(edges[n:] == 0)
                edges[lone] = 1
            more = np.flatnonzero(end >= n)
            at, state, end = at[more], state[more], end[more]
        high = np.cumsum(edges, dtype=np.int32)
        low = high - edges
        n_edges = int(high[-1])
        end, piece = np.empty(n_edges, np.int32), np.empty(n_edges, np.int32)
        for where, number, onward, which in found:
            slot = low[where] + number
            end[slot], piece[slot] = onward, which
        slot, code = low[lone], character[lone]
        end[slot], piece[slot] = onto[lone], -1 - code
        weight = pieces.weight[np.maximum(piece, 0)]
        weight[slot] = (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)) * pieces.byte_weight
        # Log mass of all ways from a node to the end of its atom, nearest nodes first.
        mass, value = np.zeros(n_nodes), weight
        cuts = level.tolist()
        bounds = np.append(low, n_edges)[level].tolist()
        for t in range(1, longest + 1):
            a, b, i, j = cuts[t], cuts[t + 1], bounds[t], bounds[t + 1]
            here = value[i:j]
            here += mass[end[i:j]]
            heads = low[a:b] - i
            top = np.maximum.reduceat(here, heads)
            total = np.add.reduceat(np.exp(here - np.repeat(top, edges[a:b])), heads)
            mass[a:b] = top + np.log(total)
        log_share = value - np.repeat(mass, edges)
        # Where the share of each edge ends among those of its node.
        sums = np.append(0, np.cumsum(np.exp(log_share)))
        upto = np.minimum(sums[1:] - np.repeat(sums[low], edges), 1.0)
        upto[high[n:] - 1] = 1.0
        entry = np.empty(n, np.int64)
        entry[order] = level[lengths[order]] + np.arange(n)
        added = {
            "length": lengths, "entry": first_node + entry, "uses": np.zeros(n, np.int32), "left": left,
            "owner": first_atom + order[rank], "low": first_edge + low, "high": first_edge + high,
            "end": first_node + end, "piece": piece, "log_share": log_share, "upto": upto,
        }
        for name, grown in self._grown.items():
            grown.add(added[name])
            self._look(name)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each node an edge, by its share."""
        edge = self.low[node]
        # Nodes have few edges, and most draws end at the first ones.
        open_ = np.flatnonzero(self.upto[edge] <= u)
        u = u[open_]
        while len(open_):
            further = edge[open_] + 1
            edge[open_] = further
            on = np.flatnonzero(self.upto[further] <= u)
            open_, u = open_[on], u[on]
        return edge

    def nodes_of(self, edges: np.ndarray) -> np.ndarray:
        """Where edges start. Ends have no edges; they stand before the nodes of the same ``low``."""
        return np.searchsorted(self.low, edges.astype(np.int32), "right") - 1

    def log_rest(self, edge: np.ndarray) -> np.ndarray:
        """Log share of the other edges of the same node; an only edge has a log share of 0."""
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(-np.expm1(np.minimum(self.log_share[edge], 0)), 0))

    def ids(self, edges: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each path."""
        bounds = np.cumsum([0, *map(len, edges)])
        pieces = self.piece[np.concatenate(edges)]
        lone = np.flatnonzero(pieces < 0)
        if len(lone):
            code = -1 - pieces[lone]
            counts = np.ones(len(pieces), np.int64)
            counts[lone] += (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            bounds = np.append(0, np.cumsum(counts))[bounds]
            pieces = np.repeat(pieces, counts)
            text = code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            pieces[pieces < 0] = self.pieces.byte_ids[np.frombuffer(text, np.uint8)]
        cuts = bounds.tolist()
        return [pieces[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _atoms(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The atoms of all texts, and how many each text has; a text that is not empty gets a blank before it.

    An atom is a line end, or a word with the blanks before it, or blanks that no word follows.
    """
    raw = [(" " + t).encode() if t else b"" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    first = np.cumsum(sizes) - sizes
    blank, line = data == 0x20, data == 0x0A
    begins = line | blank
    begins[1:] &= ~(blank[1:] & blank[:-1])
    begins[1:] |= line[:-1]
    begins[first[sizes > 0]] = True
    at = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(at, np.append(first, len(data))))
    bounds = pa.py_buffer(np.append(at, len(data)))
    return pa.LargeStringArray.from_buffers(len(at), bounds, pa.py_buffer(data)), counts


class _Batch:
    """All texts of a batch, their atoms end to end."""

    def __init__(self, texts: list[str], seeds: np.ndarray, lattices: Lattices) -> None:
        atoms, counts = _atoms(texts)
        self.atom = lattices.numbers(atoms)
        self.lattices = lattices if len(atoms) else None
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.seeds = seeds[self.doc]
        # Where the atom ends in its text, in characters.
        ends = np.append(0, np.cumsum(lattices.length[self.atom], dtype=np.int64))
        self.until = ends[1:] - ends[self.bounds[:-1]][self.doc]

    def follow(self, atom_at: np.ndarray, node: np.ndarray, path: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges drawn from the given nodes to the ends of their atoms, in order, their atom and place."""
        lat = self.lattices
        where, edges, places = [], [], []
        # Like atoms side by side: their edges are near each other.
        like = np.argsort(node)
        atom_at, node = atom_at[like], node[like]
        while len(atom_at):
            place = self.until[atom_at] - lat.left[node]
            edge = lat.draw(node, _uniform(self.seeds[atom_at], 2 * path, place))
            where.append(atom_at)
            edges.append(edge)
            places.append(place)
            node = lat.end[edge]
            on = np.flatnonzero(lat.left[node])
            atom_at, node = atom_at[on], node[on]
        counts = np.zeros(len(self.atom), np.int64)
        for at in where:
            counts[at] += 1
        first = np.cumsum(counts) - counts
        n = int(counts.sum())
        out, place_at = np.empty(n, np.int32), np.empty(n, np.int64)
        for step, at in enumerate(where):
            slot = first[at] + step
            out[slot], place_at[slot] = edges[step], places[step]
        return out, np.repeat(np.arange(len(counts)), counts), place_at

    def beside(
        self, edges: np.ndarray, atom_at: np.ndarray, place: np.ndarray, before: np.ndarray, bound: np.ndarray, path: int
    ) -> np.ndarray:
        """Maxima of what is left beside a path at each of its pieces."""
        u = _uniform(self.seeds[atom_at], 2 * path + 1, place)
        return _below(before + self.lattices.log_rest(edges), bound, u)


@dataclass
class _Path:
    edges: np.ndarray
    log_prob: float
    before: np.ndarray
    beside: np.ndarray
    taken: dict[int, list[int]]
    noisy: float


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums before each entry, starting anew at each bound."""
    sums = np.append(0, np.cumsum(values))
    return sums[:-1] - np.repeat(sums[bounds[:-1]], np.diff(bounds))


def sample_batch(
    texts: list[str], seeds: np.ndarray, pieces: Pieces, k: int, lattices: Lattices | None = None
) -> list[list[tuple]]:
    """For each text up to ``k`` distinct (ids, log probability, log inclusion score).

    In the order drawn. The inclusion score is the probability that the segmentation is among
    the k, given the noise of the first one left out; a text with no more than k
    segmentations gives all of them, with a score of one. ``lattices`` holds those of earlier batches.
    """
    batch = _Batch(texts, seeds, lattices or Lattices(pieces))
    lat = batch.lattices
    every = np.arange(len(batch.atom))
    edges, atom_at, place = (
        batch.follow(every, lat.entry[batch.atom], 0) if lat else (np.empty(0, np.int64),) * 3
    )
    doc = batch.doc[atom_at]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    root = -np.log(-np.log(_uniform(seeds, 0, np.full(len(texts), -2, np.int64))))
    steps = lat.log_share[edges] if lat else np.empty(0)
    before = _sums(steps, bounds)
    beside = batch.beside(edges, atom_at, place, before, root[doc], 0) if lat else before
    queues: list[list[_Path]] = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        total = float(before[b - 1] + steps[b - 1]) if b > a else 0.0
        queues.append([_Path(edges[a:b], total, before[a:b], beside[a:b], {}, float(root[i]))])

    def best(paths: list[_Path]):
        tops = [(p.beside.max(initial=-np.inf), n) for n, p in enumerate(paths)]
        top, n = max(tops, key=lambda x: (x[0], -x[1]))
        return (float(top), n, int(paths[n].beside.argmax())) if top > -np.inf else None

    for r in range(1, k):
        tops = [(i, *top) for i, paths in enumerate(queues) if len(paths) >= r and (top := best(paths))]
        if not tops:
            break
        who, noisy = np.array([x[0] for x in tops]), np.array([x[1] for x in tops])
        cut_at = np.array([x[3] for x in tops])
        chosen = _uniform(seeds[who], 1_000_000 + 2 * r, cut_at).tolist()
        split = lat.nodes_of(np.array([queues[i][n].edges[t] for i, _, n, t in tops]))
        heads, rests, tail_atoms, tail_nodes = [], [], [], []
        for (i, _, n, t), u, low, high in zip(tops, chosen, lat.low[split].tolist(), lat.high[split].tolist()):
            path = queues[i][n]
            taken = path.taken.setdefault(t, [int(path.edges[t])])
            others = np.array([e for e in range(low, high) if e not in taken])
            share = np.exp(lat.log_share[others])
            cut = np.cumsum(share)
            drawn = min(np.searchsorted(cut, u * cut[-1], "right"), len(others) - 1)
            rest = share.sum() - share[drawn]
            rests.append(path.before[t] + np.log(rest) if len(others) > 1 and rest > 0 else -np.inf)
            edge = int(others[drawn])
            taken.append(edge)
            # The atom of piece t: the pieces before it tell how many atoms have ended.
            at = batch.bounds[i] + t - np.count_nonzero(lat.left[lat.end[path.edges[:t]]])
            inside = lat.left[lat.end[edge]] > 0
            after = np.arange(at if inside else at + 1, batch.bounds[i + 1])
            nodes = lat.entry[batch.atom[after]]
            if inside:
                nodes[0] = lat.end[edge]
            tail_atoms.append(after)
            tail_nodes.append(nodes)
            heads.append(edge)
        left = _below(np.array(rests), noisy, _uniform(seeds[who], 1_000_001 + 2 * r, cut_at))
        edges, atom_at, place = batch.follow(np.concatenate(tail_atoms), np.concatenate(tail_nodes), r)
        doc = batch.doc[atom_at]
        low, high = np.searchsorted(doc, who), np.searchsorted(doc, who, "right")
        entry = np.array([queues[i][n].before[t] for i, _, n, t in tops]) + lat.log_share[heads]
        bounds = np.append(low, len(doc))
        steps = lat.log_share[edges]
        before = _sums(steps, bounds) + np.repeat(entry, high - low)
        beside = batch.beside(edges, atom_at, place, before, np.repeat(noisy, high - low), r)
        for (i, top, n, t), edge, rest, first, a, b in zip(tops, heads, left, entry, low, high):
            path = queues[i][n]
            if not path.beside.flags.writeable or path.beside.base is not None:
                path.beside = path.beside.copy()
            path.beside[t] = rest
            total = float(before[b - 1] + steps[b - 1]) if b > a else float(first)
            queues[i].append(_Path(
                np.concatenate([path.edges[:t], [edge], edges[a:b]]), total,
                np.concatenate([path.before[: t + 1], before[a:b]]),
                np.concatenate([np.full(t + 1, -np.inf), beside[a:b]]), {}, top,
            ))
    results, ids = [], iter(lat.ids([p.edges for paths in queues for p in paths]) if lat else ())
    for paths in queues:
        top = best(paths)
        found = []
        for p in paths:
            gap = p.log_prob - top[0] if top else np.inf
            score = gap if gap < -30 else float(np.log(-np.expm1(-np.exp(min(gap, 700.0)))))
            found.append((next(ids, p.edges), p.log_prob, score))
        results.append(found)
    return results


def row_seeds(keys: list, seed: int) -> np.ndarray:
    return np.array(
        [xxhash.xxh3_64_intdigest(f"{seed}:{key}".encode()) for key in keys], np.uint64
    )


def _ranges(lengths: list[int], most: int):
    """Ranges of rows with at most ``most`` characters, or of one row."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def decode_table(
    df: DataFrame, model_file: str = MODEL, ids_col: str = "ids", into: str = "decoded",
    pieces: Pieces | None = None,
) -> DataFrame:
    """``df`` with the text of each list of ids as column ``into``.

    Exact for every segmentation that ``sample`` gives. NULL stays NULL; no ids are an empty text.
    An empty table gives an empty one; a column named ``into`` is replaced.
    """
    known = pieces or Pieces.load(model_file)
    kept = [c for c in df.columns if c != into]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def decoded(batches):
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_pylist()
            for a, b in _ranges(lengths, BATCH_CHARS):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], decode_batch(part.column(0), known)], names=[*kept, into]
                )

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{into}` string"])
    ids = F.col(f"`{ids_col}`").cast("array<int>").alias("_ids")
    return df.select(ids, *[F.col(f"`{c}`") for c in kept]).mapInArrow(decoded, schema)


def sample(
    docs: DataFrame, k: int = 2, seed: int = 0, model_file: str = MODEL, id_col: str = "doc_id",
    text_col: str = "text", pieces: Pieces | None = None, with_row: bool = False, decoded: bool = False,
) -> DataFrame:
    """Up to ``k`` segmentations per row: id, ``sample`` (from 1), ``ids``, ``log_prob``, ``log_inclusion``.

    Segmentations of a row are distinct, drawn without replacement by their probability, and
    ``decode`` turns each into the text it came from. The noise follows from ``seed`` and the
    id, so rows that repeat id and text repeat the result. An empty text has one
    segmentation, of no ids; NULL counts as empty. Any character is encoded, as bytes where
    there is no piece. An empty table gives an empty one. With ``with_row`` all columns of the
    row stay, otherwise only the id; columns of ``docs`` named like a result are then replaced.
    With ``decoded`` the ids are decoded where they are drawn, into a column of that name, as
    ``decode_table`` does for a table.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    known = pieces or Pieces.load(model_file)
    results = {"sample": "int", "ids": "array<int>", "log_prob": "double", "log_inclusion": "double"}
    if decoded:
        results["decoded"] = "string"
    kept = [c for c in docs.columns if c not in results] if with_row else [id_col]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    # Texts are most of what a task is sent, so a text that stays is not sent a second time.
    sent = kept if text_col in kept else [*kept, text_col]
    text_at = 1 + sent.index(text_col)

    def segment(batches):
        lattices = Lattices(known)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(text_at)), 0).to_pylist()
            for a, b in _ranges(lengths, BATCH_CHARS):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(text_at).to_pylist()]
                found = sample_batch(texts, row_seeds(part.column(0).to_pylist(), seed), known, k, lattices)
                rows = [(n, s, *x) for n, f in enumerate(found) for s, x in enumerate(f, 1)]
                source, number, ids, log_prob, inclusion = zip(*rows)
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                flat = np.concatenate(ids).astype(np.int32)
                at, lists = pa.array(source), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))
                columns = [*(c.take(at) for c in part.columns[1 : 1 + len(kept)]), pa.array(number, pa.int32()), lists,
                           pa.array(log_prob), pa.array(inclusion)]
                if decoded:
                    columns.append(decode_batch(lists, known))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *results])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{n} {t}" for n, t in results.items())])
    key = F.col(f"`{id_col}`").cast("string").alias("_key")
    return docs.select(key, *[F.col(f"`{c}`") for c in sent]).mapInArrow(segment, schema)
