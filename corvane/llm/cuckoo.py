"""A cuckoo filter of 16-bit fingerprints that supports deletion and is stored as bytes."""

from __future__ import annotations

import numpy as np

SLOTS, LEAST, LOAD, KICKS = 4, 64, 0.8, 200


def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket hash and non-zero fingerprint of 16-byte keys."""
    words = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
    return words[:, 0], (words[:, 1] >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


class Cuckoo:
    """One table of buckets, sized for a number of keys, and a stash of the whole keys whose eviction chain ran out.

    Keys of equal fingerprint that share a bucket share both of their buckets, so a removal takes a fingerprint that is as good as the
    key's own: with one table no removal can hide another key. Over its size the filter stays right, as keys go to the stash; its owner
    builds it anew then.
    """

    def __init__(self, size: int = 0, body: bytes | None = None) -> None:
        if body is None:
            buckets = LEAST
            while buckets * SLOTS * LOAD < size:
                buckets *= 2
            self.table, self.keys, self.stash = np.zeros((buckets, SLOTS), np.uint16), 0, set()
        else:
            buckets, self.keys, stashed = np.frombuffer(body, "<u8", 3).tolist()
            self.table = np.frombuffer(body, "<u2", buckets * SLOTS, 24).reshape(buckets, SLOTS).copy()
            rest = body[24 + 2 * buckets * SLOTS :]
            self.stash = {rest[16 * i : 16 * i + 16] for i in range(stashed)}

    def body(self) -> bytes:
        return np.array([len(self.table), self.keys, len(self.stash)], "<u8").tobytes() + self.table.astype("<u2").tobytes() + b"".join(sorted(self.stash))

    @property
    def crowded(self) -> bool:
        return bool(self.stash) or self.keys > self.table.size * LOAD

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & (len(self.table) - 1)

    def add(self, key: bytes) -> None:
        (hashed,), (mark,) = (x.tolist() for x in halves([key]))
        self.keys += 1
        table, at = self.table, hashed & (len(self.table) - 1)
        trail: list[tuple[int, int, int]] = []
        for kick in range(KICKS):
            for spot in (at, self._other(at, mark)):
                if len(free := np.flatnonzero(table[spot] == 0)):
                    table[spot, free[0]] = mark
                    return
            at, slot = self._other(at, mark), kick % SLOTS
            trail.append((at, slot, int(table[at, slot])))
            table[at, slot], mark = mark, int(table[at, slot])
        for at, slot, before in reversed(trail):
            table[at, slot] = before
        self.stash.add(key)

    def remove(self, key: bytes) -> None:
        """Takes out a key that was added."""
        (hashed,), (mark,) = (x.tolist() for x in halves([key]))
        self.keys -= 1
        if key in self.stash:
            self.stash.remove(key)
            return
        at = hashed & (len(self.table) - 1)
        for spot in (at, self._other(at, mark)):
            if len(found := np.flatnonzero(self.table[spot] == mark)):
                self.table[spot, found[0]] = 0
                return

    def has(self, keys: list[bytes]) -> np.ndarray:
        """Never false for a key that was added and not removed."""
        hashed, marks = halves(keys)
        last = np.uint64(len(self.table) - 1)
        at = hashed & last
        other = (at ^ (marks.astype(np.uint64) * np.uint64(0x5BD1E995))) & last
        found = ((self.table[at] == marks[:, None]) | (self.table[other] == marks[:, None])).any(axis=1)
        if self.stash:
            found |= np.fromiter((k in self.stash for k in keys), bool, len(keys))
        return found
