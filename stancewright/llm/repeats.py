"""Which of very many 64-bit keys occur in more than one place.

Tasks hand on the distinct keys of a chunk of texts, packed by bucket; one group per bucket
finds the keys that several chunks share. A bucket is chosen by bits that are independent
of the key, so a group sees about ``BUCKET_KEYS`` keys at any table size, and two different
windows are taken for one with a probability of about ``BUCKET_KEYS`` / 2**64, also at any
size. A chunk sends each key once, so a key that a third of all texts hold reaches its
bucket once per chunk, not once per text.
"""

from __future__ import annotations

import numpy as np

BUCKET_KEYS = 1_000_000


def bucket_count(keys: int) -> int:
    return max(1, -(-keys // BUCKET_KEYS))


#: From so many keys on the table of top bytes is no longer than the bytes it saves.
TABLE_PAYS = 1_024


def packed(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys in at most 8 bytes each, and one more.

    Many keys take 7 bytes: how often each top byte occurs is written first, then the other bytes. As
    a table grows a chunk has ever fewer keys in a bucket; few keys are written as they are.
    """
    if len(sorted_keys) < TABLE_PAYS:
        return b"\0" + sorted_keys.astype("<u8").tobytes()
    tops = np.bincount((sorted_keys >> np.uint64(56)).astype(np.int64), minlength=256)
    low = sorted_keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    return b"\1" + tops.astype("<u4").tobytes() + low.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\0":
        return np.frombuffer(blob, "<u8", offset=1)
    tops = np.frombuffer(blob, "<u4", 256, offset=1)
    low = np.frombuffer(blob, np.uint8, offset=1025).reshape(-1, 7)
    keys = np.zeros((len(low), 8), np.uint8)
    keys[:, :7] = low
    keys[:, 7] = np.repeat(np.arange(256, dtype=np.uint8), tops)
    return keys.view("<u8").ravel()


class ChunkKeys:
    """Distinct keys of a chunk in the order of bucket and key, and where each one was.

    The order follows from the keys alone, so a chunk that is read again agrees with what was
    said about its buckets.
    """

    def __init__(self, keys: np.ndarray, spread: np.ndarray, buckets: int) -> None:
        bucket = (spread % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((keys, bucket))
        bucket, keys = bucket[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.keys, self.bucket = keys[new], bucket[new]

    def counts(self) -> np.ndarray:
        return np.bincount(self.place, minlength=len(self.keys))

    def parts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Buckets that occur, and the places of their keys."""
        names, starts = np.unique(self.bucket, return_index=True)
        return names, np.split(np.arange(len(self.keys)), starts[1:]) if len(names) else []

    def ranges(self, buckets: np.ndarray):
        """First and last place, exclusive, of the keys of each bucket."""
        return zip(np.searchsorted(self.bucket, buckets), np.searchsorted(self.bucket, buckets, "right"))


def totals(blocks: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For blocks of distinct keys with counts: the count of each key over all blocks."""
    together, weight = np.concatenate(blocks), np.concatenate(counts)
    order = np.argsort(together, kind="stable")
    found = together[order]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    number = np.cumsum(new) - 1
    out = np.empty(len(found), np.int64)
    out[order] = np.bincount(number, weight[order]).astype(np.int64)[number]
    return np.split(out, np.cumsum([len(b) for b in blocks])[:-1])


def shared(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """For blocks of distinct keys: which keys of each block another block has too."""
    together = np.concatenate(blocks)
    order = np.argsort(together, kind="stable")
    found = together[order]
    twin = np.zeros(len(found), bool)
    same = found[1:] == found[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    flags = np.empty(len(found), bool)
    flags[order] = twin
    return np.split(flags, np.cumsum([len(b) for b in blocks])[:-1])
