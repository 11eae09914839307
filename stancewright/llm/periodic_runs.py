"""Stretches of words that repeat themselves: maximal runs, and texts without the repetitions.

Texts are dealt over tasks as they lie in the table; nothing is shuffled. Inside a task the words
of a batch of texts form one enhanced suffix array, in arrays: the order of the suffixes, its
inverse and the common prefixes of neighbours. Every square whose first half is followed by
another word than its second half lies in the interval of common prefixes of just its period, with
its two halves in different children. So for each interval the suffixes of all children but the
largest ask the inverse whether the suffix one period further, or one period back, lies in the same
interval. Each square found is rotated to the left as long as its words repeat, which gives the run
that it ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancewright.llm.words import raw_texts

#: Bytes of text that share a suffix array; a longer text has its own.
BATCH_BYTES = 2 << 20
#: How often the words left are counted again; more rounds only spare work.
ROUNDS = 4


def _repeating_stretches(words: np.ndarray, text: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that a run can cover, and the stretch that each one lies in.

    A run holds each of its words at least ``times`` times, so words that are rarer in their text, or
    in the stretch that is left, part the text; stretches shorter than ``least`` hold no run.
    """
    at, stretch = np.arange(len(words)), text
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, number, n = np.unique(stretch * (words.max() + 1) + words, return_inverse=True, return_counts=True)
        often = n[number] >= times
        at, stretch, words = at[often], stretch[often], words[often]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(stretch) != 0)
        stretch = np.cumsum(new) - 1
        long = np.bincount(stretch)[stretch] >= least if len(at) else often[:0]
        at, stretch, words = at[long], stretch[long], words[long]
        if often.all() and long.all():
            break
    return at, stretch


def _group_starts(keys: np.ndarray) -> np.ndarray:
    """For sorted keys: the place of the first equal one."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return first[np.cumsum(new) - 1]


class _SuffixArray:
    """Suffixes of stretches of words in order; equal prefixes end with their stretch.

    ``ranks[k]`` tells suffixes apart by their first 2**k words, with one entry more for the end. The
    order is taken no further than ``deepest`` words.
    """

    def __init__(self, words: np.ndarray, stretch: np.ndarray, deepest: int) -> None:
        n = len(words)
        keys = stretch * (int(words.max()) + 1) + words
        self.suffix = np.argsort(keys, kind="stable")
        rank = np.full(n + 1, -1, np.int64)
        rank[self.suffix] = _group_starts(keys[self.suffix])
        self.ranks = [rank]
        while 1 << (len(self.ranks) - 1) < deepest:
            rank = self._doubled(rank, 1 << (len(self.ranks) - 1))
            if rank is None:
                break
            self.ranks.append(rank)
        self.place = np.empty(n, np.int64)
        self.place[self.suffix] = np.arange(n)
        self.common = self._common_prefixes()

    def _doubled(self, rank: np.ndarray, step: int) -> np.ndarray | None:
        """Ranks by twice as many words; only suffixes that still share a rank move."""
        sorted_ranks = rank[self.suffix]
        tied = np.zeros(len(self.suffix), bool)
        same = sorted_ranks[1:] == sorted_ranks[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        if not len(places):
            return None
        moving = self.suffix[places]
        keys = rank[moving] * len(rank) + rank[np.minimum(moving + step, len(rank) - 1)] + 1
        order = np.argsort(keys, kind="stable")
        self.suffix[places] = moving[order]
        # Places of one group are consecutive, so the first of equal keys gives the new rank.
        found = rank.copy()
        found[moving[order]] = places[_group_starts(keys[order])]
        return found

    def equal(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Whether the 2**k words at ``a`` and ``b`` agree; a place before or behind all words agrees with none."""
        n = len(self.suffix)
        inside = (a >= 0) & (b >= 0) & (a < n) & (b < n)
        return inside & (self.ranks[k][np.clip(a, 0, n)] == self.ranks[k][np.clip(b, 0, n)])

    def _common_prefixes(self) -> np.ndarray:
        """Words that each suffix shares with the one before it, up to twice the deepest rank."""
        common = np.zeros(len(self.suffix), np.int64)
        met = 1 + np.flatnonzero(self.ranks[0][self.suffix[1:]] == self.ranks[0][self.suffix[:-1]])
        a, b = self.suffix[met - 1], self.suffix[met]
        found = np.zeros(len(met), np.int64)
        for k in reversed(range(len(self.ranks))):
            found += self.equal(a + found, b + found, k).astype(np.int64) << k
        common[met] = found
        return common


def _last_smaller(values: np.ndarray) -> np.ndarray:
    """For each entry the last place before it with a smaller value; the first entry is the smallest."""
    before = np.arange(len(values)) - 1
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        open_ = open_[values[before[open_]] >= values[open_]]
        open_ = open_[before[open_] >= 0]
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
    return before


def _first_smaller_behind(values: np.ndarray) -> np.ndarray:
    """For each entry the first place behind it with a smaller value, or the length."""
    n = len(values)
    mirrored = _last_smaller(np.concatenate([[-1], values[::-1]]))
    return n - mirrored[n - np.arange(n)]


def _branching_squares(array: _SuffixArray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of squares, up to a period of ``deepest``, that the next word ends."""
    common, n = array.common, len(array.suffix)
    # An interval goes by its first place and its depth; places with just that depth cut it.
    cut = np.flatnonzero((common > 0) & (common <= deepest))
    if not len(cut):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    depth, low, high = common[cut], _last_smaller(common)[cut], _first_smaller_behind(common)[cut] - 1
    order = np.lexsort((cut, depth, low))
    cut, depth, low, high = cut[order], depth[order], low[order], high[order]
    opens = np.ones(len(cut), bool)
    opens[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    heads = np.flatnonzero(opens)
    # One child lies before the first cut, and one behind each cut.
    closes = np.append(opens[1:], True)
    child_low = np.concatenate([low[heads], cut])
    child_high = np.concatenate([cut[heads], np.where(closes, high + 1, np.append(cut[1:], 0))]) - 1
    interval = np.concatenate([np.arange(len(heads)), np.cumsum(opens) - 1])
    size = child_high - child_low + 1
    by_size = np.lexsort((-size, interval))
    small = np.ones(len(size), bool)
    small[by_size[np.searchsorted(interval[by_size], np.arange(len(heads)))]] = False
    # Every suffix of every child but the largest, with its interval.
    counts = size[small]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    suffix = array.suffix[np.repeat(child_low[small], counts) + within]
    owner = heads[np.repeat(interval[small], counts)]
    starts, periods = [], []
    for step in (1, -1):
        partner = suffix + step * depth[owner]
        inside = (partner >= 0) & (partner < n)
        place = array.place[np.where(inside, partner, 0)]
        inside &= (place >= low[owner]) & (place <= high[owner])
        starts.append(np.minimum(suffix, partner)[inside])
        periods.append(depth[owner][inside])
    start, period = np.concatenate(starts), np.concatenate(periods)
    branching = ~array.equal(start + period, start + 2 * period, 0)
    return start[branching], period[branching]


def find_runs(words: np.ndarray, text: np.ndarray, min_length: int, min_times: int) -> np.ndarray:
    """Runs of texts laid end to end: rows of place, length and period, by place and period.

    ``words`` are numbers of words, ``text`` the number of the text of each word, rising.
    """
    at, stretch = _repeating_stretches(words, text, min_times, min_length)
    if not len(at):
        return np.empty((0, 3), np.int64)
    longest = int(np.bincount(stretch).max())
    array = _SuffixArray(words[at], stretch, longest // 2)
    start, period = _branching_squares(array, longest // min_times)
    end = start + 2 * period
    # First only squares whose words go on repeating to the left as far as a run needs: two
    # stretches of a power of two cover what has to be equal.
    need = np.maximum(min_length, min_times * period) - 2 * period
    alive = (start >= need) & (need < 1 << len(array.ranks))
    for k in range(len(array.ranks)):
        mine = np.flatnonzero(alive & (need >> k == 1))
        for back in (need[mine], 1 << k):
            alive[mine] &= array.equal(start[mine] - back, start[mine] - back + period[mine], k)
    start, end, period = start[alive], end[alive], period[alive]
    for k in reversed(range(len(array.ranks))):
        while (further := array.equal(start - (1 << k), start - (1 << k) + period, k)).any():
            start = np.where(further, start - (1 << k), start)
    # A square of a multiple of the period rotates to the same run.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    runs = np.stack([at[start], end - start, period], axis=1)[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _batches(texts: list[bytes]):
    """Ranges of texts of about ``BATCH_BYTES`` together."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _scanned(texts: list[bytes], min_length: int, min_times: int):
    """Words, runs and collapsed text of each text."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in split for w in words], np.int64)
    owner = np.repeat(np.arange(len(split)), sizes)
    offsets = np.cumsum(sizes) - sizes
    runs = find_runs(ids, owner, min_length, min_times) if len(ids) else np.empty((0, 3), np.int64)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(edges[:-1]) > 0
    bounds = np.searchsorted(runs[:, 0], np.append(offsets, len(ids)))
    for i, words in enumerate(split):
        own = runs[bounds[i] : bounds[i + 1]]
        found = [{"start": int(s - offsets[i]), "length": int(n), "period": int(p)} for s, n, p in own]
        gone = dropped[offsets[i] : offsets[i] + sizes[i]]
        kept = [w for w, g in zip(words, gone.tolist()) if not g] if found else words
        yield len(words), found, b" ".join(kept)


def periodic_runs(
    docs: DataFrame, min_length: int = 6, min_times: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``runs`` and ``collapsed_text``.

    A word is a maximal run of anything but blank and the control characters 9 to 13. A run is a
    stretch of consecutive words with smallest period q, words q apart being identical, that is at
    least ``min_length`` words and ``min_times`` periods long and that no neighbouring word extends;
    ``runs`` holds start (a word number from 0), length and period, by start and period.
    ``collapsed_text`` is the text without the words that a run covers after its first q words, the
    others joined by one blank. NULL, empty and blank texts have no words, no runs and an empty text.
    Every row is judged by itself, so repeated rows and ids give repeated results. An empty table
    gives an empty one; other columns are not read. A text is held in one task as a whole.
    """
    if min_times < 2 or min_length < 2:
        raise ValueError("a run repeats its words: min_times and min_length are 2 or more")
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches):
        for batch in batches:
            texts = raw_texts(batch.column("_text"))
            for a, b in _batches(texts):
                n, runs, collapsed = zip(*_scanned(texts[a:b], min_length, min_times))
                yield pa.record_batch(
                    [
                        batch.column("_id").slice(a, b - a), pa.array(n, pa.int64()),
                        pa.array(runs, pa.list_(run)), pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=["_id", "n_words", "runs", "collapsed_text"],
                )

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    found = rows.mapInArrow(
        scan, f"_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
    )
    return found.withColumnRenamed("_id", id_col)
