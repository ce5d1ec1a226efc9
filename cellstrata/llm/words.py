"""Words of a text as 64-bit numbers, by array operations over its bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd
_PART = 1 << 18  # bytes taken at once
#: Digits, lower-case letters and bytes of characters beyond ASCII stay, all else becomes 0.
_KEPT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0 for b in range(256))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(_PART, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _hashes(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], x != 0, [False]])))
    first, end = edges[::2], edges[1::2]
    power, inverse = _powers()
    run = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * power[: len(x)], out=run[1:])
    return _mixed((run[end] - run[first]) * inverse[first] + (end - first).astype(np.uint64)).view(np.int64)


def word_hashes(text: str | None) -> np.ndarray:
    """A number for each word, a run of letters, digits or characters beyond ASCII in the lower-cased text."""
    b = text.lower().encode().translate(_KEPT) if text else b""
    if len(b) < _PART:
        return _hashes(b) if b else np.zeros(0, np.int64)
    parts, at = [], 0
    while at < len(b):
        cut = b.rfind(b"\0", at, at + _PART - 1) + 1 if len(b) - at >= _PART else len(b)
        if cut <= at:  # one word of more than a part: its pieces count as words
            cut = at + _PART - 1
        parts.append(_hashes(b[at:cut]))
        at = cut
    return np.concatenate(parts)
