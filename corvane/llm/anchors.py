"""Content-defined anchors: of each window of bytes, the position of its least k-gram hash, for many texts at once."""

from __future__ import annotations

import numpy as np

SPAN, GRAM = 50, 20
REACH = SPAN - GRAM + 1  # k-grams in a window of SPAN bytes
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
TABLE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Odd hash of the k-gram at each position, by doubling the length hashed; the last gram - 1 positions are left out."""
    whole, length, out, done, step = TABLE[text], 1, None, 0, 0
    while True:
        if gram & length:
            part = whole[done : len(text) - length + 1] if done else whole
            out = part if out is None else out[: len(text) - done - length + 1] * _ODD[step % 5] + part[: len(text) - done - length + 1]
            done += length
        if 2 * length > gram:
            break
        n = max(0, len(text) - 2 * length + 1)
        whole = (whole[:n] ^ (whole[:n] >> np.uint64(29))) * _ODD[(step + 1) % 5] + whole[length : length + n]
        length, step = 2 * length, step + 1
    out = (out ^ (out >> np.uint64(32))) * _ODD[4]
    return (out ^ (out >> np.uint64(29))) | np.uint64(1)


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each run of `width` values."""
    pick, length, out = (np.minimum if least else np.maximum), 1, values
    while 2 * length <= width:
        out = pick(out[:-length], out[length:])
        length *= 2
    return pick(out[: len(out) - (width - length)], out[width - length :]) if width > length else out


class Anchors:
    """Anchors of joined texts: `at` their positions, `hash` their k-gram hashes, `text` the text each is in, `number` its place among the text's anchors.

    `least` has the least hash of each window by its start, zero where a window is not within one text.
    """

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        none = np.empty(0, np.int64)
        self.at, self.hash, self.text, self.number, self.least = none, none.astype(np.uint64), none, none, none.astype(np.uint64)
        if len(self.bytes) < SPAN:
            return
        grams = hashes(self.bytes)
        least = sliding(grams, REACH, True)
        valid = np.zeros(len(least) + 1, dtype=np.int64)
        long = sizes >= SPAN
        np.add.at(valid, self.starts[long], 1)
        np.add.at(valid, self.ends[long] - SPAN + 1, -1)
        least[np.cumsum(valid)[:-1] == 0] = 0
        pad = np.zeros(REACH - 1, np.uint64)
        most = sliding(np.concatenate([pad, least, pad]), REACH, False)
        self.at = np.flatnonzero(most == grams)
        self.hash, self.least = grams[self.at], least
        self.text = np.searchsorted(self.ends, self.at, side="right")
        first = np.searchsorted(self.text, np.arange(len(texts)))
        self.number = np.arange(len(self.at)) - first[self.text]

    def owned(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows whose least hash is that of each of these anchors."""
        at, mine = self.at[which], self.hash[which]
        starts = at[:, None] + np.arange(-(REACH - 1), 1)
        own = (self.least[np.clip(starts, 0, len(self.least) - 1)] == mine[:, None]) & (starts >= 0) & (starts < len(self.least))
        return at - (REACH - 1) + own.argmax(axis=1), at - own[:, ::-1].argmax(axis=1)
