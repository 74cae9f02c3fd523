"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

What is appended to a text can change the merges before it only within a distance that the merge list fixes,
its sufficient lookahead, and never across the end of a word. Every text is fed to a transducer part by part. It runs the merges
over windows of bytes; a token is emitted, to the digest and the decoder, once its word has ended or the lookahead lies between it
and the window's end, and the rest is kept: memory stays constant whatever the length of the text. Texts of a batch
advance side by side, so that windows are merged together with numpy; the ids of recent words are remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import pieces, python_batches

#: Words whose ids are remembered, of 16 characters on average, some 200 MB; the memory is emptied when it is full.
MEMORY = 1_000_000
#: Characters of every text that are fed at once, whatever its length.
CHUNK = 1 << 14

# The contractions that the byte-level pattern sets apart.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_ANY = regex.compile(_CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_RUNS = {k: regex.compile(m) for k, m in {"a": r"\p{L}*", "0": r"\p{N}*", " ": r"\s*", ".": r"[^\s\p{L}\p{N}]*"}.items()}


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary: itself if it is visible Latin-1, else the next free code point from 256."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 255 and b != 173:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


def _ranges(kind: str, below: int) -> str:
    """A regular expression's ranges of the code points under ``below`` whose general category starts with ``kind``."""
    inside = [unicodedata.category(chr(c)).startswith(kind) for c in range(below)] + [False]
    out, start = [], None
    for c, ok in enumerate(inside):
        if ok and start is None:
            start = c
        if not ok and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


class Splitter:
    """Pre-tokenization: cuts a text into words the way the tokenizer's byte-level pattern does.

    Texts of Latin characters go through one compiled pattern. Any other character is classed as the tokenizer itself classes
    it (its Unicode tables may be older or newer than ours) and stands in by a letter, digit, space or symbol.
    """

    LATIN = 0x250

    def __init__(self, tokenizer: Tokenizer) -> None:
        letter, number, space = _ranges("L", self.LATIN), _ranges("N", self.LATIN), "\t-\r \x85\xa0"
        self.latin = re.compile(f" ?[{letter}]+|{_CONTRACTIONS}| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.other = re.compile(f"[^\\x00-\\u{self.LATIN - 1:04x}]")
        self.pre, self.kinds = tokenizer.pre_tokenizer, {}

    def kind(self, c: str) -> str:
        if c not in self.kinds:
            joins = lambda a: len(self.pre.pre_tokenize_str(a)) == 1
            self.kinds[c] = "a" if joins("a" + c) else "0" if joins("1" + c) else "." if joins("." + c) else "\n"
        return self.kinds[c]

    def stand_in(self, text: str) -> str:
        return text.translate({ord(c): self.kind(c) for c in set(self.other.findall(text))})

    def words(self, text: str) -> list[str]:
        if self.other.search(text) is None:
            return self.latin.findall(text)
        return [text[m.start() : m.end()] for m in _ANY.finditer(self.stand_in(text))]


class Merges:
    """The vocabulary and merge list of a tokenizer file, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or (file["pre_tokenizer"] or {}).get("type") != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"] or file["normalizer"]:
            raise ValueError("a plain byte-level BPE file is needed")
        vocab, symbols = model["vocab"], byte_symbols()
        raw = {s: bytes([b]) for b, s in symbols.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = b"".join(raw[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.arrange(vocab, model["merges"])

    def arrange(self, vocab: dict[str, int], merges: list) -> None:
        """The merge list as arrays; ``byte_id`` has the first token of each symbol that a word is made of."""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        key = (self.left << 20) | self.right
        order = np.argsort(key, kind="stable")
        self._key, self._rank = np.append(key[order], np.int64(1) << 62), np.append(order, self.none)
        self._base = np.full((len(self.byte_id),) * 2, self.none, np.int64)
        code = {int(i): b for b, i in enumerate(self.byte_id)}
        for r in range(len(pairs) - 1, -1, -1):
            if (a := code.get(int(self.left[r]))) is not None and (b := code.get(int(self.right[r]))) is not None:
                self._base[a, b] = r

    def symbols(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Which of ``byte_id`` stands for each byte of the words."""
        return np.frombuffer(b"".join(words), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.searchsorted(self._key, key)
        return np.where(self._key[at] == key, self._rank[at], self.none)

    @cached_property
    def lookahead(self) -> int:
        """Bytes after which nothing that is appended changes a token: the list's sufficient lookahead.

        A merge depends on what follows it only if its right part, or a last part of that, may be taken first by a merge of
        higher priority with what comes next; that merge depends in turn on what follows it. The longest such chain is found in
        one pass over the list, as ranks along a chain only fall.
        """
        tails: dict[int, tuple[int, ...]] = {}  # a token, its last part, the last part of that ...
        best: dict[int, int] = {}
        most = 0
        for a, b, c in zip(self.left.tolist(), self.right.tolist(), self.made.tolist(), strict=True):
            ends = tails.get(b, (b,))
            tails.setdefault(c, (c, *ends))
            reach = max((best.get(x, 0) for x in ends), default=0)
            most = max(most, reach)
            best[a] = max(best.get(a, 0), len(self.bytes[b]) + reach)
        return most + max(map(len, self.bytes))

    @cached_property
    def window(self) -> int:
        """Bytes of one word that are merged at once."""
        return 4 * self.lookahead

    def stable(self, window: bytes, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """The tokens of an unfinished word's window that end at least the lookahead before its end, and the bytes that are left."""
        ends = np.cumsum([len(self.bytes[t]) for t in ids.tolist()])
        n = int(np.searchsorted(ends, len(window) - self.lookahead, side="right"))
        return ids[:n], window[int(ends[n - 1]) if n else 0 :]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and the number of tokens of each. No word is empty.

        In each round every word that has a mergeable pair merges its best one, leftmost first.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = self.symbols(words, sizes)
        ids = self.byte_id[raw]
        owner = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(raw), self.none, np.int64)  # of the pair that starts here
        inner = owner[:-1] == owner[1:]
        rank[:-1][inner] = self._base[raw[:-1], raw[1:]][inner]
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            each = np.repeat(low, sizes)
            over = each == self.none
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                keep = ~over
                ids, owner, rank, each = ids[keep], owner[keep], rank[keep], each[keep]
                continue
            hit = np.flatnonzero(rank == each)
            first = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]
            ids[first] = self.made[rank[first]]
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            at = first - np.arange(len(first))  # where the merged tokens are once their right parts are gone
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            after = at + 1 < len(ids)
            after[after] = owner[at[after]] == owner[at[after] + 1]
            rank[at] = self.none
            rank[at[after]] = self.rank(ids[at[after]], ids[at[after] + 1])
            before = at > 0
            before[before] = owner[at[before]] == owner[at[before] - 1]
            rank[at[before] - 1] = self.rank(ids[at[before] - 1], ids[at[before]])
        ids, owner = np.concatenate([*done_ids, ids]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        return ids[order].astype("<u4"), np.bincount(owner, minlength=len(words))


class WordTransducer:
    """One word, fed in parts; gives tokens as soon as they are stable."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.rest = merges, b""

    def feed(self, part: bytes) -> bytes:
        out, size = [], self.merges.window
        for i in range(0, len(part), size):
            self.rest += part[i : i + size]
            if len(self.rest) >= size:
                ids, self.rest = self.merges.stable(self.rest, self.merges.merge([self.rest])[0])
                out.append(ids.tobytes())
        return b"".join(out)

    def finish(self) -> bytes:
        rest, self.rest = self.rest, b""
        return self.merges.merge([rest])[0].tobytes() if rest else b""


class Encoder:
    """Texts to packed ids (little-endian unsigned 32-bit integers)."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.splitter = Splitter(self.tokenizer)
        self.known: dict[str, bytes] = {}
        self.held = 0  # characters of the known words
        names = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.marks = sorted({n[0] for n in names})
        self.hold = 1 + max([3, *map(len, names)])  # characters that can still become part of something longer, or decide where a space goes

    def learn(self, words: Iterable[str]) -> None:
        """Remembers the ids of whole words: each runs through the transducer window by window, all side by side."""
        names = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in names]
        found = [b""] * len(names)
        size, todo = self.merges.window, [(k, b"", 0) for k in range(len(names))]
        fed = [w[:size] for w in raw]
        while todo:
            ids, counts = self.merges.merge(fed)
            packed, ends, after = ids.tobytes(), (np.cumsum(counts) * 4).tolist(), []
            for (k, rest, at), a, b in zip(todo, [0, *ends[:-1]], ends, strict=True):
                if at + size < len(raw[k]):
                    own, rest = self.merges.stable(self._window(raw[k], at, rest), ids[a // 4 : b // 4])
                    after.append((k, rest, at + size))
                    found[k] += own.tobytes()
                else:
                    found[k] += packed[a:b]
            todo = after
            fed = [self._window(raw[k], at, rest) for k, rest, at in todo]
        self.known.update(zip(names, found, strict=True))
        self.held += sum(map(len, names))

    def _window(self, word: bytes, at: int, rest: bytes) -> bytes:
        """What is merged next of a word: what is left of its last window, and the bytes that follow."""
        return rest + word[at : at + self.merges.window]

    def streams(self, texts: list[Iterator[str]]) -> Iterator[tuple[int, bytes]]:
        """(which text, its next stable ids), for texts that come in parts. Texts advance side by side, a part at a time."""
        live = [(k, TextTransducer(self), parts, next(parts, "")) for k, parts in enumerate(texts)]
        while live:
            split, after = [], []
            for k, t, parts, part in live:
                more = next(parts, None)
                split.append((k, *t.split(part, more is None)))
                if more is not None:
                    after.append((k, t, parts, more))
            known = self.known
            missing: set[str] = set()
            for _, items, plain in split:
                missing.update([i for i in items if i not in known] if plain else [i for i in items if isinstance(i, str) and i not in known])
            if missing:
                if len(known) + len(missing) > MEMORY or self.held > 16 * MEMORY:
                    known.clear()
                    self.held, missing = 0, {i for _, items, _ in split for i in items if isinstance(i, str)}
                self.learn(missing)
            get = self.known.__getitem__
            for k, items, plain in split:
                yield k, b"".join(map(get, items) if plain else [get(i) if isinstance(i, str) else i() for i in items])
            live = after

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """All packed ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts = lambda t: (t[i : i + CHUNK] for i in range(0, len(t), CHUNK))
        for k, ids in self.streams([parts(t) for t in texts]):
            out[k].append(ids)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


class TextTransducer:
    """A text fed in parts of any size; what is kept between them is bounded."""

    def __init__(self, encoder: Encoder) -> None:
        self.e, self.rest = encoder, ""
        self.open: WordTransducer | None = None  # a word longer than a part
        self.kind = ""

    def split(self, part: str, last: bool) -> tuple[list[str | Callable[[], bytes]], bool]:
        """What can't change any more: whole words, and calls that give the ids of special tokens or of a word that is still open;
        and whether all are words."""
        self.rest += part
        out: list[str | Callable[[], bytes]] = []
        plain = self.open is None
        while any(c in self.rest for c in self.e.marks) and (m := self.e.special.search(self.rest)):
            text, self.rest = self.rest[: m.start()], self.rest[m.end() :]
            self._plain(out, text, True)
            out.append(partial(np.array([self.e.merges.special[m[0]]], "<u4").tobytes))
            plain = False
        self.rest = self.rest[self._plain(out, self.rest, last) :]
        return out, plain and self.open is None

    def _plain(self, out: list[str | Callable[[], bytes]], text: str, last: bool) -> int:
        """Adds what is certain of a text without special tokens, and returns how many characters that was; all of them if ``last``."""
        used, safe = 0, len(text) if last else max(0, len(text) - self.e.hold)
        if self.open:
            run = self._run(text)
            used = min(run, safe)
            if self.kind == " " and run < len(text):  # the last space goes with what follows
                used = min(used, run - 1)
            used = max(0, used)
            out.append(partial(self.open.feed, text[:used].encode("utf-8", "surrogatepass")))
            if run >= safe and not last:
                return used
            out.append(self.open.finish)
            self.open = None
        words, end, word = self.e.splitter.words(text[used:] if used else text), len(text), ""
        while words and end > safe:
            word = words.pop()
            end -= len(word)
        out += words
        if safe - end > max(3, CHUNK // 2):  # longer than any contraction: the last word may be of any length
            seen = self.e.splitter.stand_in(word)
            c = seen[seen[0] == " " and len(seen) > 1]
            self.kind = "a" if regex.match(r"\p{L}", c) else "0" if regex.match(r"\p{N}", c) else " " if regex.match(r"\s", c) else "."
            self.open = WordTransducer(self.e.merges)
            out.append(partial(self.open.feed, text[end:safe].encode("utf-8", "surrogatepass")))
            end = safe
        return end

    def _run(self, text: str) -> int:
        """Where the run of the open word's class that goes on at the start of ``text`` ends."""
        return _RUNS[self.kind].match(self.e.splitter.stand_in(text)).end()


class Decoder:
    """Ids fed in parts to text, by an incremental machine from bytes to characters; a part may end inside a character."""

    def __init__(self, merges: Merges) -> None:
        self.bytes, self.machine = merges.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


def text_parts(column: pa.Array, size: int = CHUNK) -> list[Iterator[str]]:
    """Each text of a column in parts of at most ``size`` bytes (four at least), read from Arrow's memory as they are asked for. Null is
    empty, bytes that aren't UTF-8 become replacement characters."""
    size = max(size, 4)  # a character's bytes, so that every part moves on

    def parts(raw: memoryview) -> Iterator[str]:
        i = 0
        while i < len(raw):
            j = min(i + size, len(raw))
            while i + size - 3 < j < len(raw) and raw[j] & 0xC0 == 0x80:  # not inside a character
                j -= 1
            yield str(raw[i:j], "utf-8", "replace")
            i = j

    return [parts(memoryview(x.as_buffer())) if x.is_valid else iter(()) for x in column]


class Digests:
    """Number and SHA-256 of a text's ids, and SHA-256 of the text decoded from them, kept up as ids come."""

    def __init__(self, merges: Merges, decode: bool) -> None:
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()
        self.decoder = Decoder(merges) if decode else None

    def feed(self, packed: bytes) -> None:
        self.n += len(packed) // 4
        self.ids.update(packed)
        if self.decoder:
            self.text.update(self.decoder.feed(packed).encode("utf-8", "surrogatepass"))

    def finish(self) -> tuple[int, str, str | None]:
        if self.decoder:
            self.text.update(self.decoder.finish().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest() if self.decoder else None


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every row; null text counts as empty.

    ``path`` is a tokenizer file that every executor has. Ids are decoded again as they come; without ``decode`` that
    column is null. Rows with the same id or a null id get a row each; an empty table gives an empty one; other columns are not read.
    """
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in pieces(batches):
            found = [Digests(e.merges, decode) for _ in range(b.num_rows)]
            for k, ids in e.streams(text_parts(b.column(1))):
                found[k].feed(ids)
            n, ids, decoded = zip(*(d.finish() for d in found), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
