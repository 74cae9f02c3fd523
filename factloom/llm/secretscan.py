"""Secret scans: fixed patterns, and a linear-chain conditional random field over the words of each line.

Words are tagged as the begin or the inside of a secret, or outside, from their shape, the words beside them and the file they are
in, and decoded by Viterbi. The field is trained here, on lines of a bounded sample of documents in which the
patterns mark secrets and made-up secrets are planted. Lines on which a bound shows that "outside" is best for every
word, nearly all of them, need no decoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_sample, pieces
from .words import SEPARATORS, WordTable, text_buffer

# The base patterns and the shortest match of each that counts.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "crf"]
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

Span = tuple[int, int, str]


def base_spans(text: str, raw: bytes, longest: int) -> list[Span]:
    """(start, end, kind) in code points. ``longest``: bytes of the text's longest word, no match of two kinds is longer."""
    out: list[Span] = []
    low = raw.translate(_LOWER)
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST["access"]]
    if longest >= SHORTEST["hex"]:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= SHORTEST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the words' features ---------------------------------------------------------------------------------------------
_DIGIT, _UPPER, _LOW, _SYMBOL, _PUNCT, _WIDE = range(6)
_CLASS = np.full(256, _PUNCT, np.int8)
_CLASS[128:] = _WIDE
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = _DIGIT, _UPPER, _LOW
_CLASS[[ord(c) for c in "+/_=-."]] = _SYMBOL
_HEXES = np.zeros(256, bool)
_HEXES[[ord(c) for c in "0123456789abcdef"]] = True
_ASSIGNS = np.zeros(256, bool)
_ASSIGNS[[ord(c) for c in ":="]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ":={}[]()<>;$@`\\|&*~^%#\"'"]] = True

# Words that announce a secret.
KEYWORDS = ["password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "credential", "credentials", "auth", "authorization", "bearer", "access_key", "private_key"]
_SAID = [a + w + b for w in KEYWORDS for a in ("", '"', "'") for b in ("", ":", "=", '":', "':", '"', "'")]
_SIGNS = ["=", ":", "is", ":=", "=>", "->"]

#: Values that each feature has; two pairs of features also count jointly.
SIZES = [8, 5, 5, 3, 5, 2, 3, 4, 2, 3, 4, 2, 40, 25]
_OFFSETS = np.cumsum([0, *SIZES])


def _hash_of(words: list[str]) -> np.ndarray:
    return np.sort(WordTable(*text_buffer(pa.array(words))).hashes())


_SAID_HASHES, _SIGN_HASHES = _hash_of(_SAID), _hash_of(_SIGNS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def file_class(table: WordTable) -> np.ndarray:
    """For each text of a batch how much of it, white space aside, are signs that code and settings are full of."""
    size = np.zeros(len(table.count), np.int64)
    marks = np.zeros(len(table.count), np.int64)
    np.add.at(size, table.row, table.end - table.start)
    np.add.at(marks, table.row, _per_word(_MARKS, table))
    return np.searchsorted([0.002, 0.02, 0.08], marks / np.maximum(size, 1), side="right")


def _per_word(kind: np.ndarray, table: WordTable) -> np.ndarray:
    """How many bytes of a kind each word has. What lies between words is white space, which is of no kind asked for."""
    if not len(table.start):
        return np.zeros(0, np.int64)
    return np.add.reduceat(kind[table.raw], table.start, dtype=np.int64)


def counts(table: WordTable) -> np.ndarray:
    """For each word what its features are made of, as integers: its bytes, how many are of each kind and differ in kind from the one before, whether
    it starts upper case, announces a secret, is a sign or ends in one. Those of a word's parts add up to its own, as ``_whole`` does."""
    raw, start, end = table.raw, table.start, table.end
    if not len(start):
        return np.zeros((0, 13), np.int32)
    no_space = ~SEPARATORS
    digits, upper, lower, symbols, punct = (_per_word((_CLASS == k) & no_space, table) for k in (_DIGIT, _UPPER, _LOW, _SYMBOL, _PUNCT))
    hexes, assigns = _per_word(_HEXES, table), _per_word(_ASSIGNS, table)
    kinds = _CLASS[raw]
    change = np.zeros(len(raw), bool)  # the byte differs in kind from the one before, in the same word
    change[1:] = kinds[1:] != kinds[:-1]
    change[start] = False
    change &= no_space[raw]
    turns = np.add.reduceat(change, start, dtype=np.int64)
    lowered = WordTable.__new__(WordTable)
    lowered.raw, lowered.start, lowered.end = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8), start, end
    h = lowered.hashes()
    return np.stack([end - start, digits, upper, lower, symbols, punct, hexes, assigns, turns, _CLASS[raw[start]] == _UPPER, _among(h, _SAID_HASHES), _among(h, _SIGN_HASHES), _ASSIGNS[raw[end - 1]].astype(bool)], axis=1, dtype=np.int32, casting="unsafe")


def _whole(raw: memoryview, start: int, end: int) -> np.ndarray:
    """The counts of one very long word, part by part; it is longer than any that announces a secret."""
    out = None
    for i in range(start, end, PART):
        part = np.frombuffer(raw[i : min(i + PART, end)], np.uint8)
        own = counts(WordTable(part, np.array([0, len(part)])))
        if out is None:
            out = own
        else:
            out[:, :9] += own[:, :9]
            out[0, 8] += _CLASS[raw[i]] != _CLASS[raw[i - 1]]
            out[:, 12] = own[:, 12]
    out[:, 10:12] = 0
    return out


def features(table: WordTable, line: np.ndarray, file: np.ndarray | None = None) -> list[np.ndarray]:
    """The features of each word, as small integers. ``line``: a number for each word's line; neighbours are of the same line.
    ``file``: the class of each text's file, by default of the text itself."""
    return _features(counts(table), line, (file_class(table) if file is None else file)[table.row])


def _features(counted: np.ndarray, line: np.ndarray, file: np.ndarray) -> list[np.ndarray]:
    size, digits, upper, lower, symbols, punct, hexes, assigns, turns, starts_upper, said, sign, ends_open = counted.T
    starts_upper, said, sign, ends_open = (x.astype(bool) for x in (starts_upper, said, sign, ends_open))
    n = np.maximum(size, 1)
    length = np.searchsorted([4, 8, 12, 16, 20, 28, 40], n, side="right")
    share = np.where(digits == 0, 0, 1 + np.searchsorted([0.2, 0.5, 0.9], digits / n, side="right"))
    case = np.where(upper + lower == 0, 0, np.where(upper == 0, 1, np.where(lower == 0, 4, np.where((upper == 1) & starts_upper, 2, 3))))
    turning = np.searchsorted([0.05, 0.15, 0.3, 0.45], turns / n, side="right")

    def beside(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by > 0:
            out[by:] = np.where(line[by:] == line[:-by], x[:-by], 0)
        else:
            out[:by] = np.where(line[:by] == line[-by:], x[-by:], 0)
        return out

    role = np.where(said, 1, np.where(sign, 2, np.where(ends_open, 3, 0)))
    return [length, share, case, np.minimum(symbols, 2), turning, ((n >= 16) & (hexes >= 0.8 * n)).astype(int), np.minimum(punct, 2), beside(role, 1), beside(said.astype(int), 2), np.minimum(beside(role, -1), 2), file, ((assigns > 0) & ~ends_open).astype(int), length * 5 + turning, share * 5 + case]


def lines_of(table: WordTable) -> np.ndarray:
    """A number for each word's line; it differs between lines and between texts."""
    breaks = np.flatnonzero(table.raw == 10)
    return np.searchsorted(breaks, table.start) + table.row


# --- the field -------------------------------------------------------------------------------------------------------
OUTSIDE, BEGIN, INSIDE = range(3)


@dataclass
class Field:
    """Weights of the features' values and of transitions between tags (scores, not probabilities)."""

    weights: np.ndarray
    steps: np.ndarray
    shortest: int = 12  # bytes of the shortest word that its tag alone makes a secret

    def emissions(self, found: list[np.ndarray]) -> np.ndarray:
        e = np.zeros((len(found[0]), 3), np.float32)
        for offset, values in zip(_OFFSETS, found, strict=False):
            e += self.weights[offset + values]
        return e

    def decode(self, e: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best tags of all words: Viterbi on each line that can hold anything but "outside"."""
        tags = np.zeros(len(e), np.int8)
        if not len(e):
            return tags
        # However a stretch of other tags is placed, each of its words gains at most this over "outside".
        step = max(0.0, float(self.steps.max() - self.steps[OUTSIDE, OUTSIDE]))
        hope = e[:, 1:].max(axis=1) - e[:, OUTSIDE] + 2 * step > 0
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        after = np.append(first[1:], len(e))
        for k in np.flatnonzero(np.logical_or.reduceat(hope, first)):
            tags[first[k] : after[k]] = self._viterbi(e[first[k] : after[k]].tolist())
        return tags

    def _viterbi(self, e: list[list[float]]) -> list[int]:
        t = self.steps.tolist()
        score = [e[0][OUTSIDE], e[0][BEGIN], -1e9]  # a line doesn't start inside
        back = []
        for x in e[1:]:
            came, now = [], []
            for y in range(3):
                p = max(range(3), key=lambda z, y=y: score[z] + t[z][y])
                came.append(p)
                now.append(score[p] + t[p][y] + x[y])
            back.append(came)
            score = now
        y = max(range(3), key=score.__getitem__)
        out = [y]
        for came in reversed(back):
            y = came[y]
            out.append(y)
        return out[::-1]


def _logsum(z: np.ndarray) -> np.ndarray:
    m = z.max(axis=1, keepdims=True)
    return m[:, 0] + np.log(np.exp(z - m).sum(axis=1))


def fit(found: list[np.ndarray], line: np.ndarray, tags: np.ndarray, rounds: int = 80, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Maximum likelihood by full-batch Adam; the gradient is by forward and backward sums over all lines at once."""
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    size = np.diff(np.append(first, len(line)))
    longest = int(size.max())
    place = np.full((len(first), longest), -1)
    for t in range(longest):
        place[size > t, t] = first[size > t] + t
    mask = place >= 0
    onehot = np.eye(3)[tags]
    columns = [o + v for o, v in zip(_OFFSETS, found, strict=False)]
    true_w = np.zeros((_OFFSETS[-1], 3))
    for c in columns:
        np.add.at(true_w, c, onehot)
    true_s = np.zeros((3, 3))
    same = line[1:] == line[:-1]
    np.add.at(true_s, (tags[:-1][same], tags[1:][same]), 1)
    w, s = np.zeros((_OFFSETS[-1], 3)), np.zeros((3, 3))
    s[OUTSIDE, INSIDE] = -4.0
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    for step in range(1, rounds + 1):
        e = sum(w[c] for c in columns)
        x = np.where(mask[..., None], e[np.maximum(place, 0)], 0)
        up = np.zeros((len(first), longest, 3))
        up[:, 0] = x[:, 0] + np.array([0, 0, -1e9])
        for t in range(1, longest):
            up[:, t] = np.where(mask[:, t, None], _logsum(up[:, t - 1, :, None] + s[None]) + x[:, t], up[:, t - 1])
        down = np.zeros_like(up)
        for t in range(longest - 2, -1, -1):
            down[:, t] = np.where(mask[:, t + 1, None], _logsum((down[:, t + 1] + x[:, t + 1])[:, :, None] + s.T[None]), 0)
        total = _logsum(up[:, -1][:, :, None])[:, 0]
        p = np.exp(up + down - total[:, None, None]) * mask[..., None]
        each = np.zeros((len(line), 3))
        each[place[mask]] = p[mask]
        gw = np.zeros_like(w)
        for k in range(3):
            for c in columns:
                gw[:, k] += np.bincount(c, each[:, k], len(w))
        pair = up[:, :-1, :, None] + s[None, None] + (x[:, 1:] + down[:, 1:])[:, :, None, :] - total[:, None, None, None]
        gs = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        for k, (value, grad) in enumerate(((w, (true_w - gw) / len(first) - decay * w), (s, (true_s - gs) / len(first) - decay * s))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(w.astype(np.float32), s)


# --- training lines --------------------------------------------------------------------------------------------------
_LETTERS = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))


def made_up_secret(rng: np.random.Generator) -> str:
    """A random string of one of the usual forms."""
    pick = lambda alphabet, n: "".join(rng.choice(alphabet, n))
    forms = [
        lambda: pick(np.array(list("0123456789abcdef")), int(rng.integers(24, 65))),
        lambda: pick(np.append(_LETTERS, ["+", "/"]), int(rng.integers(24, 65))) + "=" * int(rng.integers(0, 3)),
        lambda: "AKIA" + pick(_LETTERS[list(range(26)) + list(range(52, 62))], 16),
        lambda: str(rng.choice(["ghp_", "sk-", "xoxb-", "glpat-", "pk_live_"])) + pick(_LETTERS, int(rng.integers(20, 41))),
        lambda: ".".join(pick(np.append(_LETTERS, ["-", "_"]), int(n)) for n in rng.integers(20, 44, 3)),
        lambda: pick(_LETTERS, int(rng.integers(16, 33))),
        lambda: pick(np.append(_LETTERS, list("!#$%&*?-_")), int(rng.integers(10, 17))),
    ]
    return forms[int(rng.integers(len(forms)))]()


def made_up_decoy(rng: np.random.Generator) -> str:
    """A string that looks odd among words but is no secret: an address, a link, a date, a version, a number, a name of code."""
    pick = lambda n: "".join(rng.choice(_LETTERS[26:52], n))
    d = lambda n: "".join(rng.choice(_LETTERS[52:], n))
    forms = [
        lambda: f"{pick(6)}.{pick(7)}@{pick(8)}.{pick(3)}", lambda: f"{pick(5)}{d(2)}@{pick(9)}.{pick(4)}.{pick(2)}",
        lambda: f"https://{pick(9)}.{pick(3)}/{pick(8)}/{pick(10)}-{d(4)}?{pick(2)}={d(3)}", lambda: f"www.{pick(12)}.{pick(3)}",
        lambda: f"20{d(2)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}", lambda: f"v{d(1)}.{d(2)}.{d(2)}-{pick(5)}", lambda: f"+{d(2)} {d(3)} {d(7)}", lambda: d(int(rng.integers(5, 17))),
        lambda: f"{pick(6).title()}{pick(7).title()}{pick(5).title()}()", lambda: f"{pick(7)}_{pick(8)}_{pick(6)}", lambda: f"/{pick(4)}/{pick(8)}/{pick(9)}.{pick(3)}", lambda: "-" * int(rng.integers(4, 60)),
        lambda: f"{pick(8)}-{pick(9)}-{pick(7)}", lambda: f"{d(3)}.{d(3)}.{d(2)}.{d(2)}", lambda: f"#{d(6)}", lambda: f"({pick(9)},",
    ]
    return forms[int(rng.integers(len(forms)))]()


def training_lines(texts: list[str], lines: int, words: int = 40, seed: int = 0, secret=made_up_secret) -> tuple[list[str], list[list[int]], np.ndarray]:
    """At most ``lines`` lines of at most about ``words`` words, a third with a planted secret and a third with a decoy, the tags
    of their words, and the class of the file that each is from."""
    rng = np.random.default_rng(seed)
    files = file_class(WordTable(*text_buffer(pa.array(texts, pa.string()))))
    pool = [(p, f) for t, f in zip(texts, files.tolist(), strict=True) for line in t.split("\n") if (w := re.findall(r"[^\x20\x09-\x0D]+", line)) for p in (w[i : i + words - 4] for i in range(0, len(w), words - 4))]
    chosen = [pool[i] for i in rng.permutation(len(pool))[:lines]]
    out, tags = [], []
    said = [["token", "="], ["password:"], ["secret", "="], ['"api_key":'], ["key", "is"], ["Bearer"], ["pwd", "="], []]
    for k, (line, _) in enumerate(chosen):
        tag = [OUTSIDE] * len(line)
        text = " ".join(line)
        spans = base_spans(text, text.encode("utf-8", "surrogatepass"), 1 << 30)
        at = np.cumsum([0, *(len(w) + 1 for w in line)])
        for start, end, kind in spans:
            if kind == "assign":  # the value, which ends the match
                start = ASSIGN.match(text, start).start(1)
            inside = [i for i in range(len(line)) if at[i] < end and at[i + 1] - 1 > start]
            for j, i in enumerate(inside):
                tag[i] = INSIDE if j else BEGIN
        if k % 3 < 2:
            quote = str(rng.choice(["", "", '"', "'"]))
            before = said[int(rng.integers(len(said)))] if k % 3 == 0 else []
            new = (quote + secret(rng) + quote).split() if k % 3 == 0 else made_up_decoy(rng).split()
            i = int(rng.integers(len(line) + 1))
            if i == len(line) or tag[i] != INSIDE:
                line = [*line[:i], *before, *new, *line[i:]]
                tag = [*tag[:i], *[OUTSIDE] * len(before), *([BEGIN] if k % 3 == 0 else [OUTSIDE] * len(new)), *tag[i:]]
        out.append(" ".join(line))
        tags.append(tag)
    return out, tags, np.array([f for _, f in chosen], int)


def _made(texts: list[str], lines: int, seed: int, secret=made_up_secret) -> tuple[WordTable, list[np.ndarray], np.ndarray]:
    made, tags, files = training_lines(texts, lines, seed=seed, secret=secret)
    table = WordTable(*text_buffer(pa.array(made, pa.string())))
    return table, features(table, table.row, files), np.array([t for x in tags for t in x], int)


def train(texts: list[str], lines: int = 2400, seed: int = 0, precision: float = 0.98) -> Field:
    """A field from three quarters of the texts' lines; the others say from which length on tags are right in ``precision`` of the cases."""
    cut = max(1, len(texts) * 3 // 4)
    table, found, tags = _made(texts[:cut], lines, seed)
    if not len(tags):  # no words to learn from: nothing but the patterns
        return Field(np.zeros((_OFFSETS[-1], 3), np.float32) - np.array([0, 9, 9], np.float32), np.zeros((3, 3)))
    field = fit(found, table.row, tags)
    table, found, tags = _made(texts[cut:] or texts, lines // 2, seed + 1)
    said = field.decode(field.emissions(found), table.row) == BEGIN
    size, right = (table.end - table.start)[said], tags[said] != OUTSIDE
    field.shortest = next((n for n in range(SHORTEST["assign"], 40) if (size >= n).any() and right[size >= n].mean() >= precision), 40)
    return field


def measured(field: Field, texts: list[str], lines: int, seed: int, secret=made_up_secret) -> tuple[float, float]:
    """Precision and recall of tagged words on made-up lines of other texts."""
    table, found, tags = _made(texts, lines, seed, secret)
    said = (field.decode(field.emissions(found), table.row) != OUTSIDE) & (table.end - table.start >= field.shortest)
    hit = (said & (tags != OUTSIDE)).sum()
    return float(hit / max(said.sum(), 1)), float(hit / max((tags != OUTSIDE).sum(), 1))


_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_VALUES = np.array([_VALUE.match(chr(i)) is not None for i in range(256)])


def _value(word: str) -> tuple[int, int]:
    """Where the first run of a secret's characters in a word starts and the last ends."""
    runs = [m.span() for m in _VALUE.finditer(word)]
    return (runs[0][0], runs[-1][1]) if runs else (0, 0)


def _value_in(raw: memoryview, start: int, end: int) -> tuple[int, int]:
    """``_value`` of the word at these bytes, in memory for a part of it."""
    if end - start <= PART:
        return _value(str(raw[start:end], "utf-8", "replace"))
    parts = [(i, min(i + PART, end)) for i in range(start, end, PART)]
    found = lambda i, j: np.flatnonzero(_VALUES[np.frombuffer(raw[i:j], np.uint8)])
    first = next((i + int(f[0]) for i, j in parts if len(f := found(i, j))), None)
    if first is None:
        return 0, 0
    last = next(i + int(f[-1]) + 1 for i, j in reversed(parts) if len(f := found(i, j)))
    return _points(raw, start, first), _points(raw, start, last)


def _points(raw: memoryview, start: int, end: int) -> int:
    """The code points that start between two bytes."""
    return sum(int((np.frombuffer(raw[i : min(i + PART, end)], np.uint8) & 0xC0 != 0x80).sum()) for i in range(start, end, PART))


def scan(column: pa.Array, field: Field) -> list[list[Span]]:
    """All spans of each text of a column, in code points, by start and then kind. Tagged spans that lie inside a pattern's
    are not added; those that reach further are, beside it. Long texts are gone through part by part."""
    sizes = np.diff(text_buffer(column)[1])
    out: list[list[Span]] = [[]] * len(column)
    short = np.flatnonzero(sizes <= PART)
    for k, spans in zip(short.tolist(), _scan_together(column.take(pa.array(short)), field) if len(short) else [], strict=True):
        out[k] = spans
    for k in np.flatnonzero(sizes > PART).tolist():
        out[k] = _scan_long(memoryview(column[k].as_buffer()), column[k].as_py(), field)
    return out


def _with_tagged(spans: list[Span], tagged: list[tuple[int, int]], shortest: int) -> list[Span]:
    """Spans with the tagged ones that are long enough and inside none of them; both are in the order of their starts."""
    reach, at, more = 0, 0, []  # the furthest end of a span that starts no later
    for start, end in tagged:
        while at < len(spans) and spans[at][0] <= start:
            reach, at = max(reach, spans[at][1]), at + 1
        if end - start >= shortest and end > reach:
            more.append((start, end, "crf"))
    return sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _scan_together(column: pa.Array, field: Field) -> list[list[Span]]:
    raw, offsets = text_buffer(column)
    table = WordTable(raw, offsets)
    line = lines_of(table)
    tags = field.decode(field.emissions(features(table, line)), line) if len(line) else np.zeros(0, np.int8)
    longest = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(longest, table.row, table.end - table.start)
    tagged: dict[int, list[tuple[int, int]]] = {}
    begins = np.flatnonzero(tags == BEGIN)
    for i in begins.tolist():
        j = i + 1
        while j < len(tags) and tags[j] == INSIDE and line[j] == line[i]:
            j += 1
        tagged.setdefault(int(table.row[i]), []).append((i, j))
    out = []
    for k, text in enumerate(column.to_pylist()):
        text = text or ""
        own = raw[offsets[k] : offsets[k + 1]]
        spans = base_spans(text, own.tobytes(), int(longest[k]))
        if k in tagged:
            place = np.append(0, np.cumsum((own & 0xC0) != 0x80))  # code points before each byte
            found = []
            for i, j in tagged[k]:
                at = [(int(place[table.start[x] - offsets[k]]), int(place[table.end[x] - offsets[k]])) for x in (i, j - 1)]
                a, b = (_value(text[p:q]) for p, q in at)
                found.append((at[0][0] + a[0], at[1][0] + b[1]))
            spans = _with_tagged(spans, found, field.shortest)
        out.append(spans)
    return out


#: Bytes of a long text that are gone through at once.
PART = 1 << 20


class Chain:
    """Viterbi over a line that comes in parts. Tags are given as soon as the best ways to all three agree on them, so what is kept is short."""

    def __init__(self, field: Field) -> None:
        self.steps, self.score, self.back = field.steps, None, np.zeros((0, 3), np.int8)

    def feed(self, e: np.ndarray, last: bool) -> np.ndarray:
        """The tags that are certain now, after those given before; all of them if the line ends here."""
        t, rows = self.steps.tolist(), e.tolist()
        came = np.zeros((len(rows), 3), np.int8)
        for i, x in enumerate(rows):
            if self.score is None:
                self.score = [x[OUTSIDE], x[BEGIN], -1e9]  # a line doesn't start inside
                continue
            now = []
            for y in range(3):
                best, p = max((self.score[z] + t[z][y], -z) for z in range(3))
                came[i, y] = -p
                now.append(best + x[y])
            self.score = now
        self.back = np.concatenate([self.back, came])
        n = len(self.back)
        if not n:
            return np.zeros(0, np.int8)
        ways = np.zeros((n, 3), np.int8)  # the tags of the best way to each tag of the last word
        ways[-1] = range(3)
        if last:
            ways[-1] = int(max(range(3), key=self.score.__getitem__))
        for i in range(n - 1, 0, -1):
            ways[i - 1] = self.back[i][ways[i]]
            if ways[i - 1][0] == ways[i - 1][1] == ways[i - 1][2] and not last and i > 1:
                break
        if last:
            self.score, self.back = None, np.zeros((0, 3), np.int8)
            return ways[:, 0]
        same = i - 1 if n > 1 and (ways[i - 1] == ways[i - 1][0]).all() else -1  # up to here all ways are one
        if same < 0:
            return np.zeros(0, np.int8)
        tag, tags = int(ways[same][0]), np.zeros(same + 1, np.int8)
        for k in range(same, -1, -1):
            tags[k] = tag
            tag = int(self.back[k][tag])
        self.back = self.back[same + 1 :]
        return tags


def _long_parts(raw: memoryview) -> Iterator[tuple[int, int]]:
    """Where parts of a long text start and end: after the last line break, or else blank, of so many bytes; a longer word isn't cut."""
    start, blank = 0, re.compile(rb"[\x20\x09-\x0D]")
    while start < len(raw):
        end = min(start + PART, len(raw))
        if end < len(raw):
            some = bytes(raw[start:end])
            cut = some.rfind(b"\n") + 1 or max(map(some.rfind, (b" ", b"\t", b"\v", b"\f", b"\r"))) + 1
            if cut:
                end = start + cut
            else:
                end = m.end() if (m := blank.search(raw, end)) else len(raw)
        yield start, end
        start = end


def _long_words(raw: memoryview) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(counts, line, words) of the words of each part of a long text; words: code points before, first byte, last byte."""
    lines = before = 0
    for start, end in _long_parts(raw):
        if end - start > 2 * PART:  # one word, and what ends it
            stop = end - int(bool(SEPARATORS[raw[end - 1]]))
            yield _whole(raw, start, stop), np.array([lines]), np.array([[before, start, stop]])
            lines, before = lines + int(raw[end - 1] == 10), before + _points(raw, start, end)
            continue
        part = np.frombuffer(raw[start:end], np.uint8)
        table = WordTable(part, np.array([0, len(part)]))
        points = np.append(0, np.cumsum((part & 0xC0) != 0x80))
        yield counts(table), lines + lines_of(table), np.stack([before + points[table.start], table.start + start, table.end + start], axis=1)
        lines, before = lines + int((part == 10).sum()), before + int(points[-1])


def _scan_long(raw: memoryview, text: str, field: Field) -> list[Span]:
    """The spans of one long text in memory for a part of it, besides the text: those that it would have if it were gone through at once."""
    size = marks = longest = 0
    for start, end in _long_parts(raw):
        for i in range(start, end, PART):
            part = np.frombuffer(raw[i : min(i + PART, end)], np.uint8)
            size, marks = size + int((~SEPARATORS[part]).sum()), marks + int(_MARKS[part].sum(dtype=np.int64))
        if end - start > PART:
            longest = max(longest, end - start)
        else:
            table = WordTable(np.frombuffer(raw[start:end], np.uint8), np.array([0, end - start]))
            longest = max(longest, int((table.end - table.start).max(initial=0)))
    file = np.searchsorted([0.002, 0.02, 0.08], [marks / max(size, 1)], side="right")
    chain, tagged, before = Chain(field), [], 0
    waiting = np.zeros((0, 3), np.int64)  # words of the line whose tags aren't certain: code points before, first byte, last byte
    open_: list[int] | None = None  # start and end, in code points, of a span that may go on

    def take(tags: np.ndarray, words: np.ndarray, ends: bool) -> None:
        """Makes spans of the next words' tags, which follow those taken before; ``ends``: with the line."""
        nonlocal open_
        last = -1
        for i in np.flatnonzero(tags).tolist():
            at, p, q = words[i].tolist()
            a, b = _value_in(raw, p, q)
            if open_ and (tags[i] == BEGIN or i != last + 1):
                tagged.append(tuple(open_))
                open_ = None
            if tags[i] == BEGIN:
                open_ = [at + a, at + b]
            elif open_:
                open_[1] = at + b
            last = i
        if open_ and (ends or last != len(tags) - 1):
            tagged.append(tuple(open_))
            open_ = None

    def settle(e: np.ndarray, ends: bool) -> None:
        nonlocal waiting
        tags = chain.feed(e, ends)
        if len(tags) or ends:
            take(tags, waiting[: len(tags)], ends)
        waiting = waiting[len(tags) :]

    nothing = np.zeros((0, 3), np.float32)
    on = -1  # the line that the chain is in

    def settle_words(e: np.ndarray, line: np.ndarray, words: np.ndarray) -> None:
        """Tags the next words. Lines that end among them are decoded together; the last may go on, so it is left to the chain."""
        nonlocal waiting, on
        if not len(line):
            return
        done = int(np.searchsorted(line, on, side="right"))
        waiting = np.concatenate([waiting, words[:done]])
        if done:
            settle(e[:done], False)
        if done == len(line):
            return
        settle(nothing, True)
        on, cut = int(line[-1]), int(np.searchsorted(line, line[-1]))
        ended, own = line[done:cut], words[done:cut]
        tags = field.decode(e[done:cut], ended)
        found = np.flatnonzero(tags)
        for group in np.split(found, np.flatnonzero(np.diff(ended[found])) + 1) if len(found) else []:
            lo, hi = int(group[0]), int(group[-1]) + 1
            take(tags[lo:hi], own[lo:hi], True)
        waiting = words[cut:]
        settle(e[cut:], False)

    # A word's features look at two words before it and one after: the last word of a part waits for the next part.
    held, known = None, 0
    for new in _long_words(raw):
        rows = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        n = len(rows[1])
        if n > known + 1:
            e = field.emissions(_features(rows[0], rows[1], np.broadcast_to(file, n)))
            settle_words(e[known : n - 1], rows[1][known : n - 1], rows[2][known : n - 1])
            cut = max(0, n - 3)
            rows, known = tuple(x[cut:] for x in rows), n - 1 - cut
        held = rows
    if held is not None and len(held[1]):
        e = field.emissions(_features(held[0], held[1], np.broadcast_to(file, len(held[1]))))
        settle_words(e[known:], held[1][known:], held[2][known:])
    settle(nothing, True)
    return _with_tagged(base_spans(text, bytes(raw), longest), tagged, field.shortest)


def sample_texts(docs: DataFrame, rows: int, id_col: str, text_col: str, longest: int) -> list[str]:
    """At most ``rows`` texts of under ``longest`` characters, those whose ids have the smallest hashes."""
    short = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.length("text") < longest))
    return [r[0] for r in bounded_sample(short, rows, F.col("id"), F.xxhash64("text")).select("text").collect()]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 300, fit_chars: int = 100_000, redact_with: str | None = None) -> DataFrame:
    """``docs`` plus ``secret_spans``, an array of (start, end, kind) in code points, the end exclusive.

    The field is trained on at most ``fit_rows`` documents of under ``fit_chars`` characters; all documents are scanned whole. With
    ``redact_with`` the text is replaced too, each stretch of overlapping spans by that string. Null text has no
    spans and stays null. Rows are scanned each for itself, so repeated rows and null or repeated ids are no matter; an empty
    table gives an empty one, other columns stay, one called secret_spans is replaced.
    """
    Workspace(docs.sparkSession, "secrets")
    field = train(sample_texts(docs, fit_rows, id_col, text_col, fit_chars))
    names = [c for c in docs.columns if c != "secret_spans"]
    docs = docs.select(*names)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in pieces(batches):
            spans = scan(b.column(at), field)
            columns = list(b.columns)
            if redact_with is not None:
                columns[at] = pa.array([t if not s else redact(t, s, redact_with) for t, s in zip(columns[at].to_pylist(), spans, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in spans], kind)], [*names, "secret_spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema + ", secret_spans array<struct<start:int,end:int,kind:string>>")


def redact(text: str, spans: list[Span], by: str) -> str:
    """The text with each stretch of overlapping spans (in order of their starts) replaced by ``by``."""
    out, done = [], 0
    for start, end, _ in spans:
        if start >= done:
            out += [text[done:start], by]
        done = max(done, end)
    return "".join([*out, text[done:]])
