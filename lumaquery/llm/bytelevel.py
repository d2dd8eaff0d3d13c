"""Splitting texts into the words of a byte-level BPE vocabulary, and the
word-to-ids cache that the encoders share.

A batch of texts is one array of code points; the word boundaries come from
comparing character classes of neighbours, so no regular expression runs over
ordinary text.  Equal words of a batch are encoded once.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import regex

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of texts that are split and encoded at a time.
BLOCK_CHARS = 3_000_000
#: Words that a worker keeps with their ids; beyond it, the half that was met last stays.
CACHE_WORDS = 400_000

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point, by the same properties the pattern names."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(prop, points):
            lo, hi = ord(points[m.start()]), ord(points[m.end() - 1])
            table[lo : hi + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


@functools.cache
def byte_chars() -> tuple[list[str], dict[str, int]]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            chars[b] = chr(b)
        else:
            chars[b], spare = chr(spare), spare + 1
    return chars, {c: b for b, c in enumerate(chars)}


class Vocabulary:
    """A byte-level BPE vocabulary file: tokens, merges and special tokens."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        _supported(spec, path)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        _, back = byte_chars()
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in self.ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}

    @property
    def size(self) -> int:
        return max(self.bytes_of) + 1


def _supported(spec: dict, path: str) -> None:
    """Raises for a vocabulary file that splits or spells texts otherwise than this module does."""
    before = spec.get("pre_tokenizer") or {}
    wrong = []
    if spec["model"].get("type", "BPE") != "BPE" or spec["model"].get("byte_fallback") or spec["model"].get("dropout"):
        wrong.append("model")
    if spec.get("normalizer"):
        wrong.append("normalizer")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError(f"{path}: {', '.join(wrong)} not supported")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of words in ``points``; ``first`` marks each text's first character.

    A word is a run of letters, of digits or of other signs, with one space before
    it if there is one; of a longer run of white space the last character stands
    apart.  An apostrophe that begins a word takes the letters of a contraction
    with it, and what letters follow are the next word.
    """
    kind = char_classes()[points]
    n = len(kind)
    last = np.empty(n, bool)  # last character of its text
    last[:-1] = first[1:]
    last[-1:] = True
    space = kind == SPACE
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # what follows one space joins it
    joins = (points == 32) & ~last
    joins[:-1] &= ~space[1:]
    after = np.zeros(n, bool)
    after[1:] = joins[:-1]
    starts &= ~after | first
    # the last of several white space characters before a word
    inner = space & ~last
    inner[:-1] &= ~space[1:]
    starts |= inner
    at = np.flatnonzero((points == 39) & starts)
    if len(at):
        size = contraction(points, first, at)
        at, size = at[size > 0], size[size > 0]
        starts[at + 1] = False
        end = at + 1 + size
        end = end[end < n]
        starts[end[kind[end] == LETTER]] = True
    return starts


def contraction(points: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many letters of a contraction follow each apostrophe in its text: 0, 1 or 2."""
    n = len(points)
    one, two = np.minimum(at + 1, n - 1), np.minimum(at + 2, n - 1)
    there = (at + 1 < n) & ~first[one]
    a, b = points[one], points[two]
    more = there & (at + 2 < n) & ~first[two]
    single = there & np.isin(a, [ord(x) for x in "stmd"])
    double = more & ((np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
    return np.where(single, 1, np.where(double, 2, 0))


def split_slow(text: str) -> list[str]:
    return regex.findall(PATTERN, text)


class WordEncoder:
    """Texts to ids by way of their distinct words.

    ``encode_words`` turns distinct words into the array of all their ids and
    the array of each word's number of ids.
    """

    def __init__(self, vocab: Vocabulary, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.vocab, self.encode_words = vocab, encode_words
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        #: the call that met each word last
        self.last, self.calls = np.zeros(0, np.int64), 0

    def _forget(self) -> None:
        """Leaves the words that were met last, at most half of them."""
        stay = np.flatnonzero(self.last > np.partition(self.last, len(self.last) // 2)[len(self.last) // 2])
        words = list(self.slot)
        self.slot = {words[k]: n for n, k in enumerate(stay.tolist())}
        self.flat, sizes = self._gather(stay)
        self.offsets, self.last = np.concatenate([[0], np.cumsum(sizes)]), self.last[stay]

    def _slots(self, words: list[str]) -> np.ndarray:
        """Index of each word's ids, of words new to the cache as well."""
        if len(self.slot) > CACHE_WORDS:
            self._forget()
        self.calls += 1
        found = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            absent = [words[k] for k in missing.tolist()]
            new = list(dict.fromkeys(absent))
            ids, sizes = self.encode_words(new)
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, ids])
            base = len(self.slot)
            self.slot.update(zip(new, range(base, base + len(new)), strict=True))
            self.last = np.append(self.last, np.zeros(len(new), np.int64))
            found[missing] = np.arange(base, base + len(new)) if len(new) == len(absent) else np.fromiter(map(self.slot.__getitem__, absent), np.int64, len(absent))
        self.last[found] = self.calls
        return found

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of words, and the number of ids of each word."""
        begin, sizes = self.offsets[slots], self.offsets[slots + 1] - self.offsets[slots]
        ends = np.cumsum(sizes)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)
        return self.flat[take], sizes

    def _plain(self, text: str) -> np.ndarray:
        return self._gather(self._slots(split_slow(text)))[0] if text else np.zeros(0, np.uint32)

    def one(self, text: str) -> np.ndarray:
        """Ids of one text by the pattern itself; special tokens are found first."""
        parts, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            parts += [self._plain(text[at : m.start()]), np.array([self.vocab.special[m.group()]], np.uint32)]
            at = m.end()
        return np.concatenate([*parts, self._plain(text[at:])])

    def _ordinary(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of non-empty texts without special tokens."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        first = np.zeros(len(points), bool)
        first[begins] = True
        starts = np.flatnonzero(word_starts(points, first)).astype(np.int32)
        length = np.diff(starts, append=np.int32(len(points)))
        place = np.arange(len(points), dtype=np.int32) - np.repeat(starts, length)
        which, distinct = pd.factorize(np.add.reduceat(mixed(points, place), starts))
        chosen = np.zeros(len(distinct), np.int32)
        chosen[which[::-1]] = np.arange(len(which), dtype=np.int32)[::-1]
        # equal hashes must mean equal words
        model = chosen[which]
        if not (length == length[model]).all() or not (points == points[np.repeat(starts[model], length) + place]).all():
            return [self.one(t) for t in texts]
        ends = starts + length
        words = [whole[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)]
        ids, per_word = self._gather(self._slots(words)[which])
        bounds = np.concatenate([[0], np.cumsum(per_word)])[np.searchsorted(starts, begins)]
        return np.split(ids, bounds[1:])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, a block of texts at a time."""
        for block in blocks(texts):
            odd = [bool(not t or (self.special and self.special.search(t))) for t in block]
            usual = [t for t, x in zip(block, odd, strict=True) if not x]
            found = iter(self._ordinary(usual) if usual else [])
            for t, x in zip(block, odd, strict=True):
                yield self.one(t) if x else next(found)


def mixed(points: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit number for each character and its place in its word."""
    x = place.astype(np.uint64)
    x <<= np.uint64(21)
    x += points
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts, up to BLOCK_CHARS characters unless one text is longer."""
    block, held = [], 0
    for t in texts:
        if block and held + len(t) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append(t)
        held += len(t)
    if block:
        yield block


_library: dict[str, WordEncoder] = {}


def library_encoder(path: str) -> WordEncoder:
    """Encoder whose distinct words go through the tokenizers library; one a worker."""
    if path not in _library:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, table = tokenizer.model, np.array([*map(ord, byte_chars()[0])], "<u2")
        table[0xFF] = 10  # no byte of UTF-8, so it parts the words

        def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids: list[int] = []
            sizes = []
            raw = np.frombuffer("\udcff".join(words).encode("utf-8", "surrogateescape"), np.uint8)
            for w in table[raw].tobytes().decode("utf-16-le").split("\n"):
                tokens = model.tokenize(w)
                ids.extend([t.id for t in tokens])
                sizes.append(len(tokens))
            return np.array(ids, np.uint32), np.array(sizes, np.int64)

        _library[path] = WordEncoder(vocabulary(path), encode_words)
    return _library[path]
