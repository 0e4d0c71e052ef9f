"""Word hashes of many texts at once, by array operations on their bytes.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; a longer word makes a longer step.
STEP = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (fixed values: the constants of MurmurHash3's finaliser)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            up, down = np.full(n, _P, _U), np.full(n, pow(_P, -1, 1 << 64), _U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)


_POWERS = _Powers()


def _hash_step(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in a run of bytes."""
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    _POWERS.reach(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * _POWERS.up[: len(raw)], out=total[1:])
    sums = (total[ends] - total[starts]) * _POWERS.down[starts]
    return mixed(sums + (ends - starts).astype(_U)), starts, ends


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of some UTF-8 bytes."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= STEP:
        return _hash_step(data)
    parts, at = [], 0
    while at < len(data):
        end = at + STEP
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        h, s, e = _hash_step(data[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def groups(rows: Iterator[tuple], size: int = STEP) -> Iterator[list[tuple]]:
    """Rows (text bytes last) gathered until their texts reach ``size``."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's words begin (one more number: the end); then the joined
    bytes and each word's start and end in them."""
    joined = b"\n".join(texts)
    hashes, starts, ends = words(joined)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins), joined, starts, ends
