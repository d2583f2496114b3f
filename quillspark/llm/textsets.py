"""Word-shingle sets of texts, hashed over whole batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.bpe import slices

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Texts are hashed together until they hold this many bytes; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Value of each byte in a word's hash.
_VALUE = _LOWER.astype(np.uint64) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            full = np.ones(n, dtype=np.uint64)
            full[1:] = _P
            self.up = np.cumprod(full, dtype=np.uint64)
            full[1:] = _P_INV
            self.down = np.cumprod(full, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a byte buffer, in order; words are runs of bytes of ``kinds`` (256 flags)."""
    word = kinds[data]
    edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        up, down = _POWERS.to(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        values = _VALUE[data]
        values *= up[: len(data)]
        np.cumsum(values, out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return _mix(h + (ends - starts).astype(np.uint64) * _MIX[1]), starts, ends


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes (uint64) of each text's ``width``-word shingles, words lower-cased in A-Z.

    A text with fewer words has its whole sequence as one; one without words, or null, has none. The texts' bytes are
    read where Arrow holds them.
    """
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    for a, b in slices(texts, BATCH_BYTES):
        part = texts.slice(a, b - a)
        _, offsets, data = part.buffers()
        at = np.frombuffer(offsets, dtype=wide)[part.offset : part.offset + len(part) + 1].tolist()
        held = memoryview(data or b"")
        yield from _sets([held[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], width)


def _sets(buffers: list, width: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        data = np.frombuffer(b"\n".join(buffers) + b"\n", dtype=np.uint8)
        words, starts, _ = word_hashes(data, ~_SPACE)
        ends = np.cumsum([len(b) + 1 for b in buffers])
        firsts = np.concatenate(([0], np.searchsorted(starts, ends)))
        scale = _mix(np.arange(1, width + 1, dtype=np.uint64) * _P)
        whole = max(0, len(words) - width + 1)
        rolled = np.full(whole, width, dtype=np.uint64)
        for k in range(width):
            rolled += words[k : k + whole] * (scale[k] | np.uint64(1))
        rolled = _mix(rolled)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            n = b - a
            if n >= width:
                s = np.sort(rolled[a : b - width + 1])
                new = np.empty(len(s), dtype=bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            elif n:
                yield _mix(np.array([n], dtype=np.uint64) + np.sum(words[a:b] * (scale[:n] | np.uint64(1)), dtype=np.uint64))
            else:
                yield np.empty(0, dtype=np.uint64)
