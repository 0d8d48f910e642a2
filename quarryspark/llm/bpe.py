"""Byte-pair encoding with word ends, and decoding.

A text is cut at the added tokens, each piece is brought to its normal form and split into words, and each word's UTF-8
bytes are the first symbols, the last one with the word's end. A segment tree lies over the ranks of adjacent pairs: its
root names the lowest rank, the way down to the left finds the leftmost pair of it, and a merge changes three leaves and
their ancestors, so a word of n symbols takes n log n steps however long it is. The trees of short words are rows of one
array that is worked on together; such a word is merged once for each task as long as it stays in a memory of bounded size.

The vocabulary file (its path is a parameter) is read on the driver and goes to the tasks as tables; texts are not shuffled.

Defined results: a null or empty text, or one of white space, has no tokens; a vocabulary without a token for each byte is an error; texts of any length are encoded whole; repeated rows are rows of their own; no rows give no rows; other columns are kept whatever their
names, but for those that are named as results.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Words up to so many characters are remembered, so many of them at most.
SHORT, REMEMBERED = 40, 400_000
#: A leaf without a mergeable pair.
NONE = 1 << 62
_ID_BITS = 20
_ID_MASK = (1 << _ID_BITS) - 1
#: Words whose trees are one array, and bytes of texts that are encoded together, about.
TOGETHER, BATCH_BYTES = 4096, 2 << 20


@dataclass
class Vocabulary:
    """The tables of one vocabulary file."""

    tokens: list[str]
    added: dict[str, int]
    pattern: str
    #: Ids of the bytes as symbols inside a word and at its end.
    inner: list[int]
    final: list[int]
    #: By (left << 20 | right): (rank << 20 | merged).
    merges: dict[int, int] = field(repr=False)
    #: The file's own text without its vocabulary, for the library's reading of characters that are new to Python.
    file: str = field(repr=False)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable in Latin-1, else the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def read_vocabulary(path: str) -> Vocabulary:
    """A tokenizer file of byte-level words with word ends; other kinds are an error."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model, suffix = j["model"], j["model"]["end_of_word_suffix"]
    steps = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in j["normalizer"]["normalizers"]]
    split, level = j["pre_tokenizer"]["pretokenizers"]
    known = steps == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True)
    known = known and (level["type"], level["use_regex"], level["add_prefix_space"]) == ("ByteLevel", False, False) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in j["added_tokens"])
    if not (known and suffix and j["decoder"] is None and not any(model[k] for k in ("unk_token", "continuing_subword_prefix", "byte_fallback", "dropout", "ignore_merges"))):
        raise ValueError(f"{path} isn't a file of byte-level words with word ends")
    vocab = model["vocab"]
    added = {t["content"]: t["id"] for t in j["added_tokens"]}
    tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, k in (vocab | added).items():
        tokens[k] = token
    if len(tokens) > 1 << _ID_BITS:
        raise ValueError(f"{path} has more than {1 << _ID_BITS} tokens")
    characters = byte_characters()
    if missing := [c for c in characters if c not in vocab or c + suffix not in vocab]:
        raise ValueError(f"{path} has no tokens for {missing}")
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[left] << _ID_BITS | vocab[right]] = rank << _ID_BITS | vocab[left + right]
    return Vocabulary(tokens, added, split["pattern"]["Regex"], [vocab[c] for c in characters], [vocab[c + suffix] for c in characters], merges, json.dumps(j | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))


def merged(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """The symbols after all merges, the lowest rank first and the leftmost of equal ones."""
    n, find = len(symbols), merges.get
    if n < 2:
        return symbols
    leaves = [find(a << _ID_BITS | b, NONE) for a, b in itertools.pairwise(symbols)]
    if min(leaves) == NONE:
        return symbols
    width = 1 << (n - 2).bit_length()
    tree = [NONE] * width + leaves + [NONE] * (width - n + 1)
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) != NONE:
        k = 1
        while k < width:  # down to the leftmost leaf of the lowest rank
            k += k
            if tree[k] != least:
                k += 1
        at = k - width
        gone, left = after[at], before[at]
        right = after[gone]
        symbols[at], symbols[gone], after[at] = least & _ID_MASK, -1, right
        changes = [(k, NONE if right == n else find(symbols[at] << _ID_BITS | symbols[right], NONE))]
        if right < n:
            before[right] = at
            changes.append((gone + width, NONE))
        if left >= 0:
            changes.append((left + width, find(symbols[left] << _ID_BITS | symbols[at], NONE)))
        for k, value in changes:
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:  # up as far as the minimum changes
                beside, k = tree[k ^ 1], k >> 1
                if beside < value:
                    value = beside
                if tree[k] == value:
                    break
                tree[k] = value
    return [s for s in symbols if s >= 0]


class Pairs:
    """The merges as sorted arrays, to look up many pairs at once."""

    def __init__(self, merges: dict[int, int]):
        self.keys = np.array(sorted(merges), dtype=np.int64)
        self.values = np.array([merges[k] for k in self.keys.tolist()], dtype=np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(rank << 20 | merged) of each pair, ``NONE`` where there is none; -1 is no symbol."""
        key = np.where((left < 0) | (right < 0), -1, left << _ID_BITS | right)
        if not len(self.keys):
            return np.full(key.shape, NONE)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def merged_many(words: list[bytes], vocabulary: Vocabulary, pairs: Pairs) -> list[bytes]:
    """``merged`` for many words at once, from UTF-8 to little-endian ids: a row of one array is a word's segment tree, and
    each round makes one merge in every row that still has one. Positions 0 and n + 1 are no symbols. Each byte
    has to be a symbol."""
    n, lengths = len(words), np.array([len(w) for w in words])
    width = 1 << int(lengths.max() + 1).bit_length()
    raw, places = np.frombuffer(b"".join(words), np.uint8), np.arange(width)
    symbols = np.full((n, width), -1, np.int64)
    symbols[(places >= 1) & (places <= lengths[:, None])] = np.array(vocabulary.inner)[raw]
    ends = np.cumsum(lengths) - 1
    symbols[np.arange(n), lengths] = np.array(vocabulary.final)[raw[ends]]
    tree = np.full((n, 2 * width), NONE, np.int64)
    tree[:, width:-1] = pairs(symbols[:, :-1], symbols[:, 1:])
    level = width
    while level > 1:
        level >>= 1
        tree[:, level : 2 * level] = tree[:, 2 * level : 4 * level].reshape(n, level, 2).min(2)
    after = np.tile(np.arange(1, width + 1), (n, 1))
    before = np.tile(np.arange(-1, width - 1), (n, 1))
    levels, rows = width.bit_length() - 1, np.arange(n)
    while len(rows := rows[tree[rows, 1] != NONE]):
        least, k = tree[rows, 1], np.ones(len(rows), np.int64)
        for _ in range(levels):  # down to the leftmost leaf of the lowest rank
            k += k
            k += tree[rows, k] != least
        at = k - width
        gone, left = after[rows, at], before[rows, at]
        right = after[rows, gone]
        symbols[rows, at], symbols[rows, gone] = least & _ID_MASK, -1
        after[rows, at], before[rows, right] = right, at
        tree[rows, at + width] = pairs(symbols[rows, at], symbols[rows, right])
        tree[rows, gone + width] = NONE
        tree[rows, left + width] = pairs(symbols[rows, left], symbols[rows, at])
        paths = [at + width, gone + width, left + width]
        for _ in range(levels):
            for p in paths:
                tree[rows, p >> 1] = np.minimum(tree[rows, p], tree[rows, p ^ 1])
            paths = [p >> 1 for p in paths]
    left_over = symbols >= 0
    ids, ends = symbols[left_over].astype("<u4").tobytes(), (4 * left_over.sum(1)).cumsum().tolist()
    return [ids[a:b] for a, b in itertools.pairwise([0, *ends])]


class _Words(dict):
    """The ids of each word as little-endian bytes; short ones are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.pairs = vocabulary, Pairs(vocabulary.merges)

    def learn(self, words: set[str]) -> None:
        """Remembers all short ones of ``words``, many at a time, those of like lengths together."""
        new = [w for w in words - self.keys() if len(w) <= SHORT]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            raw = w.encode("utf-8")
            by_width.setdefault((len(raw) + 1).bit_length(), []).append((w, raw))
        for group in by_width.values():
            for start in range(0, len(group), TOGETHER):
                some = group[start : start + TOGETHER]
                self.update(zip([w for w, _ in some], merged_many([raw for _, raw in some], self.vocabulary, self.pairs), strict=True))

    def __missing__(self, word: str) -> bytes:
        """A long word by its own tree, or one that was forgotten meanwhile."""
        v, raw = self.vocabulary, word.encode("utf-8")
        symbols = [*map(v.inner.__getitem__, raw[:-1]), v.final[raw[-1]]]
        return little_endian(merged(symbols, v.merges))


def little_endian(ids: list[int]) -> bytes:
    return b"".join([k.to_bytes(4, "little") for k in ids])


@functools.cache
def disputed(character: str) -> bool:
    """Whether editions of Unicode may tell the class, case or order of a character apart: it is unassigned in Python's own,
    or a mark that is younger than the oldest one here (the library's normal form follows an old edition)."""
    kind = unicodedata.category(character)
    return kind == "Cn" or kind[0] == "M" and unicodedata.ucd_3_2_0.category(character) == "Cn"


class Encoder:
    """Encodes lists of texts; keeps what it has learnt of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.words, self.library = vocabulary, _Words(vocabulary), None
        self.find = regex.compile(vocabulary.pattern).findall
        plain = vocabulary.pattern
        for unicode_class, ascii_class in ((r"\p{L}", "a-z"), (r"\p{N}", "0-9"), (r"\s", "\t-\r ")):
            plain = plain.replace(unicode_class, ascii_class)
        self.find_ascii = re.compile(plain).findall
        ordered = sorted(vocabulary.added, key=len, reverse=True)  # the longest that fits
        self.added = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None

    def cut(self, text: str) -> list[str]:
        """The words of a text in its normal form."""
        if text.isascii():
            return self.find_ascii(text.lower())
        if any(map(disputed, set(text))):
            return self.cut_by_library(text)
        # Each letter by itself: a final sigma is as any other.
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def cut_by_library(self, text: str) -> list[str]:
        """The same, by the library's normal form and pattern, whose editions of Unicode are its own."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.vocabulary.file)
        normal = self.library.normalizer.normalize_str(text)
        byte = {c: b for b, c in enumerate(byte_characters())}
        return [bytes([byte[c] for c in word]).decode("utf-8") for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = []  # of each text: words, an added token, words, an added token...
        for text in texts:
            parts = self.added.split(text or "") if self.added else [text or ""]
            pieces.append([self.vocabulary.added[p] if k % 2 else self.cut(p) for k, p in enumerate(parts)])
        self.words.learn(set().union(*(words for parts in pieces for words in parts[::2])))
        get = self.words
        return [b"".join([little_endian([p]) if k % 2 else b"".join([get[w] for w in p]) for k, p in enumerate(parts)]) for parts in pieces]


def decode_ids(ids: bytes, tokens: list[str]) -> str:
    """The tokens with blanks between them, as a file without a decoder says."""
    numbers = array("I", ids)
    if numbers.itemsize != 4 or array("I", b"\x01\0\0\0")[0] != 1:
        numbers = [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)]
    return " ".join([tokens[k] for k in numbers])


def _mapped(df: DataFrame, source: str, out: str, kind: T.DataType, make, sent) -> DataFrame:
    """``df`` with a column ``out`` made from ``source`` by the function of lists that ``make`` gives a task, a bounded
    number of characters (or one long text) at a time."""
    kept = [f for f in df.schema.fields if f.name != out]
    target = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()
    column = df.columns.index(source)
    places = [i for i, f in enumerate(df.schema.fields) if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make(sent.value)
        for batch in batches:
            values = batch.column(column)
            ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(batch):
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
                done = pa.array(of(values.slice(start, end - start).to_pylist()), target)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, end - start) for i in places), done], names=[f.name for f in plain])
                start = end

    # Under plain names, for a name may hold what mapInArrow reads as a quotation mark.
    plain = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate([*kept, T.StructField(out, kind)])]
    made = df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, T.StructType(plain))
    return made.toDF(*[f.name for f in kept], out)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: the ids of the text, as the bytes of little-endian unsigned 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # bounded by the file
    return _mapped(docs, text, out, T.BinaryType(), lambda v: Encoder(v).encode, sent)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the text that the ids stand for; of null ids, the empty one."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path).tokens)
    return _mapped(encoded, ids, out, T.StringType(), lambda tokens: lambda some: [decode_ids(b or b"", tokens) for b in some], sent)
