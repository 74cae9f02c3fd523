"""Words, their byte positions and 64-bit hashes over whole batches of texts, vectorised with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Word separators: space and the ASCII controls 0x09 to 0x0D. ``bytes.split()`` uses the same set.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD1B54A32D192ED03 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd, so it has an inverse)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        have = tuple(_series(b, size) for b in (base, pow(base, -1, 1 << 64)))
        _powers[base] = have
    return have


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near values spread over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and where each row starts and ends. Null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset or column.buffers()[1] is None:
        column = pa.concat_arrays([column, pa.array([""], pa.large_string())])[: len(column)]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_parts(raw: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, some ``size`` bytes at a time; a longer word comes whole."""
    carry: list[bytes] = []
    for i in range(0, len(raw), size):
        part = raw[i : i + size]
        carry.append(part)
        if i + size >= len(raw):
            yield b"".join(carry).split()
            return
        cut = max(map(part.rfind, (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")))
        if cut >= 0:
            carry[-1], rest = part[:cut], part[cut:]
            yield b"".join(carry).split()
            carry = [rest]


class WordTable:
    """Start, end and row of each word of a batch, in order."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
        else:
            sep = SEPARATORS[raw]
            edge = np.zeros(n + 1, bool)  # a text starts here
            edge[offsets] = True
            word = ~sep
            before = np.empty(n, bool)
            before[0], before[1:] = True, sep[:-1]
            after = np.empty(n, bool)
            after[-1], after[:-1] = True, sep[1:]
            self.start = np.flatnonzero(word & (before | edge[:n]))
            self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # the first word of each row; one more at the end
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if len(self.start) == 0:
            return np.zeros(0, np.uint64)
        up, down = powers(_P, len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[: len(self.raw)], out=sums[1:])
            return mix((sums[self.end] - sums[self.start]) * down[self.start])


def overlapping(raw: np.ndarray, k: int, size: int) -> Iterator[tuple[int, WordTable]]:
    """(words before, words) of parts of a text of some ``size`` bytes, such that every run of ``k`` words starts in one part and lies in it."""
    start, before, wide = 0, 0, size
    while start < len(raw):
        end = min(start + wide, len(raw))
        while end < len(raw) and not len(blank := np.flatnonzero(SEPARATORS[raw[end : end + size]])):
            end = min(end + size, len(raw))
        end += int(blank[0]) if end < len(raw) else 0
        table = WordTable(raw[start:end], np.array([0, end - start]))
        if len(table.start) < k and end < len(raw):
            wide *= 2
            continue
        yield before, table
        if end == len(raw):
            return
        before += len(table.start) - k + 1
        start, wide = (start + int(table.start[len(table.start) - k + 1]) if k > 1 else end), size


class Rolling:
    """Hashes of runs of consecutive values, each in constant time."""

    def __init__(self, values: np.ndarray, base: int = _Q) -> None:
        self.up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))
