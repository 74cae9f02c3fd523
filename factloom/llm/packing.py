"""Packing documents into training sequences by minimum bin slack.

A document's ids are cut at the capacity; what is left of it, its tail, waits in a pool. A sequence starts from the longest tail
and takes the multiset of waiting lengths that fills its room closest to capacity: a subset-sum table as one bit set for
each prefix of the lengths says which sums can be reached, and walking it backwards gives how many of each length are in the best one.
Where the best sum leaves slack, one more tail is cut to fill it and the rest of that goes back to the pool. The last
sequence of a task is cut at powers of two, which need no padding.

Every task packs the documents that it reads, so nothing is shuffled. A task holds the tails of its pool, some four million ids at most,
besides the document at hand; a lost task is done again with the same result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import bpe
from .common import pieces, python_batches, texts

#: Ids of waiting tails at which sequences are made, until half of them are left.
POOL = 4 << 20
#: Chunks of text whose ids are remembered; the memory is emptied when it is full. Longer chunks are not remembered.
MEMORY, LONG = 1_000_000, 64
#: Characters of a text that are split at once, and those after which a chunk without blanks is cut where that changes nothing.
PART, CHUNK = 1 << 18, 1 << 16
OUT = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_DIGIT_OR_SIGN = r"0-9!-&(-;=?-@\[-`{}~"
#: Between these ASCII characters a word always ends; no added token and no contraction spans them.
_SAFE = re.compile(rf"(?<=[A-Za-z])(?=[{_DIGIT_OR_SIGN}])|(?<=[{_DIGIT_OR_SIGN}])(?=[A-Za-z])|(?<=[0-9])(?=[0-9])")

#: A word of letters that every Unicode version knows, without the one whose lower case isn't a letter alone; a sign that is a word by itself may follow.
_LATIN = re.compile(r"((?:(?![²³¹¼-¾İ])[^\W\d_ɐ-\U0010ffff]){1,64})([.,]?)")


class EndedMerges(bpe.Merges):
    """The merge list of a vocabulary in which the last symbol of a word carries a suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE file with word ends is needed")
        vocab, plain = model["vocab"], [c for _, c in sorted(bpe.byte_symbols().items())]
        self.byte_id = np.array([vocab[c] for c in plain] + [vocab[c + model["end_of_word_suffix"]] for c in plain], np.int64)
        self.arrange(vocab, model["merges"])

    def symbols(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        out = super().symbols(words, sizes).astype(np.int64)
        out[np.cumsum(sizes) - 1] += 256
        return out


class WordEncoder:
    """Ids of texts by a tokenizer whose words never span a blank; chunks between blanks are encoded once and remembered.

    Chunks of Latin letters, most of all, are words as they stand and are merged together with numpy; any other goes to the library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.merges = Tokenizer.from_file(path), EndedMerges(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if one(" \n ") or one("It's a 12\n\nx<|b é") != one("it's") + one("a") + one("12") + one("x<|b") + one("é"):
            raise ValueError("a tokenizer of lower case whose words end at blanks and which drops these is needed")
        self.signs = {"": b""} | {c: np.array(one(c), "<u4").tobytes() for c in ".,"}
        self.known = dict(self.signs)

    def encode_batch(self, found: list[str]) -> Iterator[bytes]:
        """The ids of each text packed as little-endian 32-bit integers. What is new in short texts is learnt together; a long one goes part by part."""
        short = [t.replace("\n", " ").split(" ") if len(t) <= PART else None for t in found]
        few = self._learn(set().union(*(c for c in short if c is not None)))
        for text, chunks in zip(found, short, strict=True):
            yield self._long(text) if chunks is None else self._joined(chunks, few)

    def _long(self, text: str) -> bytes:
        out, rest = [], ""
        for i in range(0, len(text), PART):
            *whole, rest = (rest + text[i : i + PART].replace("\n", " ")).split(" ")
            if len(rest) > CHUNK and (cuts := [m.start() for m in _SAFE.finditer(rest)]):
                whole.append(rest[: cuts[-1]])
                rest = rest[cuts[-1] :]
            out.append(self._joined(whole, self._learn(set(whole))))
        return b"".join([*out, self._joined([rest], self._learn({rest}))])

    def _joined(self, chunks: list[str], few: dict[str, bytes]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            return b"".join([self.known[c] if c in self.known else few[c] for c in chunks])

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not known yet; those of long ones are given back instead of remembered."""
        if len(self.known) > MEMORY:
            self.known = dict(self.signs)
        known, few, others, forms = self.known, {}, [], {}
        for c in chunks.difference(known):
            if m := _LATIN.fullmatch(c):
                forms[c] = m[1].lower(), m[2]
            else:
                others.append(c)
        words = list({word for word, _ in forms.values()}.difference(known))
        known.update(zip(words, self._merged(words), strict=True))
        for c, (word, sign) in forms.items():
            known[c] = known[word] + known[sign]
        for group in _groups(others, 1 << 18):
            for c, ids in zip(group, self._asked(group), strict=True):
                (known if len(c) <= LONG else few)[c] = ids
        return few

    def _merged(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids, sizes = self.merges.merge([w.encode() for w in words])
        packed, cut = ids.tobytes(), [0, *(np.cumsum(sizes) * 4).tolist()]
        return [packed[i:j] for i, j in pairwise(cut)]

    def _asked(self, group: list[str]) -> list[bytes]:
        """Ids of each chunk, all encoded by the library as one text; the places of tokens in it tell chunks apart."""
        readable = [c if c.isascii() else c.encode("utf-8", "replace").decode() for c in group]
        found = self.tokenizer.encode(" ".join(readable), add_special_tokens=False)
        first = np.cumsum([0, *[len(c) + 1 for c in readable]])
        cut = (np.searchsorted([i for i, _ in found.offsets], first) * 4).tolist()
        packed = np.array(found.ids, "<u4").tobytes()
        return [packed[i:j] for i, j in pairwise(cut)]


def _groups(chunks: list[str], chars: int) -> Iterator[list[str]]:
    out, size = [], 0
    for c in chunks:
        out.append(c)
        size += len(c) + 16
        if size > chars:
            yield out
            out, size = [], 0
    if out:
        yield out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def closest(lengths: list[int], count: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of waiting lengths that is at most ``room``, and how many of each length make it up.

    ``lengths`` are ascending. Bit s of ``reach`` says that some multiset of the lengths seen so far sums to s; a length that
    waits n times is added in parts of 1, 2, 4 ... copies, so n of them cost log n steps.
    """
    reach, steps, all_ = 1, [], (1 << room + 1) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length, left, part = lengths[i], min(count[lengths[i]], room // lengths[i]), 1
        while left and not reach >> room:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & all_
            left, part = left - take, 2 * part
        if reach >> room:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return best, used


class Packer:
    """Sequences of one task. ``add`` and ``finish`` give pieces (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next, self.waiting = capacity, first, 0
        self.lengths: list[int] = []  # those that wait, ascending
        self.tails: dict[int, list[tuple]] = {}
        self.count: dict[int, int] = {}

    def add(self, doc: object, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        whole = n - n % self.capacity
        for start in range(0, whole, self.capacity):
            yield doc, start, ids[4 * start : 4 * (start + self.capacity)], n, self._sequence(), 0
        if whole < n:
            self._put((doc, whole, ids[4 * whole :], n))
        if self.waiting >= POOL:
            while self.waiting > POOL // 2:
                yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.lengths:
            yield from self._fill()

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _put(self, tail: tuple) -> None:
        length = len(tail[2]) // 4
        if length not in self.count:
            insort(self.lengths, length)
            self.count[length], self.tails[length] = 0, []
        self.count[length] += 1
        self.tails[length].append(tail)
        self.waiting += length

    def _take(self, length: int) -> tuple:
        tail = self.tails[length].pop()
        self.count[length] -= 1
        self.waiting -= length
        if not self.count[length]:
            del self.lengths[bisect_right(self.lengths, length) - 1], self.count[length], self.tails[length]
        return tail

    def _fill(self) -> Iterator[tuple]:
        chosen = [self._take(self.lengths[-1])]
        total = len(chosen[0][2]) // 4
        best, used = closest(self.lengths, self.count, self.capacity - total)
        chosen += [self._take(length) for length, n in used.items() for _ in range(n)]
        total += best
        if total < self.capacity and self.lengths:  # every tail that still waits is longer than the slack
            doc, start, ids, n = self._take(self.lengths[0])
            slack = self.capacity - total
            chosen.append((doc, start, ids[: 4 * slack], n))
            self._put((doc, start + slack, ids[4 * slack :], n))
            total = self.capacity
        sizes = [total] if total == self.capacity else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        room = offset = 0
        for doc, start, ids, n in chosen:
            at = 0
            while at < len(ids) // 4:
                if not room:
                    room, offset, sequence = sizes.pop(0), 0, self._sequence()
                step = min(room, len(ids) // 4 - at)
                yield doc, start + at, ids[4 * at : 4 * (at + step)], n, sequence, offset
                at, offset, room = at + step, offset + step, room - step


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): a row for each piece of a document in a sequence, its ids packed
    as little-endian 32-bit integers unless they aren't asked for.

    ``path`` is a tokenizer file that every executor has, of one whose words end at blanks. ``end_id`` follows each document; a null or empty text
    is that id alone. Every id is in exactly one piece; ``start`` counts the document's ids before the piece, ``offset`` those of its
    sequence. A sequence holds at most ``capacity`` ids; only the last few of a task hold fewer, powers of two. Rows with the same or a
    null id are documents of their own; an empty table gives an empty one; other columns are not read. A text's ids are held whole,
    four bytes each, and so is a word of any length.
    """
    if capacity < 1 or not 0 <= end_id < 1 << 32:
        raise ValueError("capacity must be positive, and end_id an unsigned 32-bit integer")
    if id_col.lower() in (*OUT, "ids"):
        raise ValueError(f"{id_col} is the name of a column of the result")
    python_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, packer, kind = encoder(path), Packer(capacity, TaskContext.get().partitionId() << 33), None

        def made() -> Iterator[tuple]:
            nonlocal kind
            for b in pieces(batches, 1024):
                kind = b.column(0).type
                for doc, ids in zip(b.column(0).to_pylist(), e.encode_batch(texts(b)), strict=True):
                    yield from packer.add(doc, ids + end)
            yield from packer.finish()

        rows, size = [], 0
        for row in made():
            rows.append(row)
            size += len(row[2]) + 64
            if size > 1 << 21:
                yield _batch(rows, kind, id_col, with_ids)
                rows, size = [], 0
        if rows:
            yield _batch(rows, kind, id_col, with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *[f"{c} long" for c in OUT], *["ids binary"] * with_ids]))


def _batch(rows: list[tuple], kind: pa.DataType, id_col: str, with_ids: bool) -> pa.RecordBatch:
    doc, start, ids, n, sequence, offset = zip(*rows, strict=True)
    longs = [start, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], n, sequence, offset]
    columns = [pa.array(doc, kind), *[pa.array(x, pa.int64()) for x in longs], *[pa.array(ids, pa.binary())] * with_ids]
    return pa.RecordBatch.from_arrays(columns, [id_col, *OUT, *["ids"] * with_ids])
