"""Operators whose next step depends on where the last one ended: vectorised Python functions."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types as objects: a worker that imports this module can't parse their names.
_STRINGS = T.ArrayType(T.StringType())
#: Characters of a part, characters that neighbours share, and of a packed chunk of sentences (fixed values).
PART, OVERLAP, SENTENCES, LEAST = 1800, 200, 900, 20


def split_overlapping(text: str, most: int = PART, overlap: int = OVERLAP) -> list[str]:
    """Parts of at most ``most`` characters that overlap; a cut goes to the last sentence end, line end or blank
    in the second half of a part, if there is one."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while True:
        end = start + most
        if end < len(text):
            cut = max(text.rfind(mark, start, end) for mark in (". ", "\n", " ")) - start
            if cut > most // 2:
                end = start + cut + 1
        if part := text[start:end].strip():
            out.append(part)
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


@F.pandas_udf(_STRINGS)
def overlapping_parts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: split_overlapping(x or ""))


def pack_sentences(text: str, most: int = SENTENCES, least: int = LEAST) -> list[str]:
    """Sentences joined into chunks of at most ``most`` characters; a sentence beyond that is sliced into chunks of its own, which
    nothing is joined to; chunks of ``least`` or fewer are dropped."""
    chunks, now = [], ""
    for sentence in re.split(r"(?<=[.!?])\s+", " ".join(text.split())):
        if now and len(now) + 1 + len(sentence) > most:
            chunks.append(now)
            now = ""
        if len(sentence) > most:
            chunks += [sentence[k : k + most] for k in range(0, len(sentence), most)]
        else:
            now = f"{now} {sentence}" if now else sentence
    return [x for x in [*chunks, now] if len(x.strip()) > least]


@F.pandas_udf(_STRINGS)
def sentence_chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: pack_sentences(x or ""))


def _of_json(text: str | None, result):
    """``result`` of the value that a text of JSON stands for; null for null and for what can't be read."""
    try:
        return None if text is None else result(json.loads(text))
    except (ValueError, RecursionError):  # lone surrogates can't be encoded, either
        return None


@F.pandas_udf(T.StringType())
def canonical_json_hash(texts: pd.Series) -> pd.Series:
    """sha256 of JSON with sorted keys and no blanks; null if it isn't JSON."""
    plain = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    return texts.map(lambda x: _of_json(x, lambda v: hashlib.sha256(plain(v)).hexdigest()))


@F.pandas_udf(T.StringType())
def point_id(names: pd.Series) -> pd.Series:
    """Version 5 UUID of a name."""
    return names.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, x)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for an embedding: bytes of chained digests, scaled to -1..1."""

    def one(text: str, size: int = 64) -> list[float]:
        digest, out = hashlib.sha256((text or "").encode()).digest(), []
        while len(out) < size:
            out += [b / 127.5 - 1.0 for b in digest]
            digest = hashlib.sha256(digest).digest()
        return out[:size]

    return texts.map(one)


_SECRET = re.compile(r"password|secret|token|authorization|api_?key|email|phone", re.I)


def redact_nested(value):
    """Values of sensitive keys are masked, at any depth."""
    if isinstance(value, dict):
        return {k: "***" if _SECRET.search(k) else redact_nested(v) for k, v in value.items()}
    return [redact_nested(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def redacted_json(texts: pd.Series) -> pd.Series:
    """Null for what isn't JSON (it may hold secrets) or holds half a character."""
    return texts.map(lambda x: _of_json(x, lambda v: json.dumps(redact_nested(v), ensure_ascii=False).encode().decode()))


#: Words near a name that betray a signature, and confidences of full names (fixed values).
SIGNATURE = re.compile(r"\b(?:üdv|tisztelettel|köszönettel|best regards|kind regards|sincerely|regards|signature|signed by)\b", re.I)
NAME_BASE, NAME_LISTED, NAME_BOOST, NAME_MOST = 0.70, 0.75, 0.05, 0.85
MAIL_NEAR, SIGNATURE_NEAR = 120, 200
_UPPER = "A-ZÁÉÍÓÖŐÚÜŰ"
_PAIR = re.compile(rf"\b([{_UPPER}][\w-]+)\s+([{_UPPER}][\w-]+)\b")
_MAIL = re.compile(r"[\w.+-]+@[\w.-]+\.\w+")


def person_names(text: str, given: frozenset[str], listed: frozenset[str]) -> list[tuple[str, int, int, float]]:
    """(name, start, end, confidence) of capitalised pairs with a given name (lower-cased) in either place, which goes first
    in the result; surer for names that are listed, near an e-mail address, or near a signature."""
    out = []
    for m in _PAIR.finditer(text):
        one, two = m[1], m[2]
        if one.lower() not in given:
            if two.lower() not in given:
                continue
            one, two = two, one
        near = lambda pattern, window: pattern.search(text[max(0, m.start() - window) : m.end() + window]) is not None  # noqa: B023, E731
        sure = NAME_LISTED if f"{one} {two}".lower() in listed else NAME_BASE
        sure += NAME_BOOST * near(_MAIL, MAIL_NEAR) + NAME_BOOST * near(SIGNATURE, SIGNATURE_NEAR)
        out.append((f"{one} {two}", m.start(), m.end(), round(min(sure, NAME_MOST), 2)))
    return out


_NAMES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("confidence", T.DoubleType())]))


def full_names(given, listed=()):
    """The vectorised form, for lists of given and of known full names."""
    first, known = frozenset(x.lower() for x in given), frozenset(x.lower() for x in listed)

    @F.pandas_udf(_NAMES)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: person_names(x or "", first, known))

    return run


_WORD = "A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű0-9"
_WORDS = re.compile(rf"[{_WORD}]{{2,}}")
_NEXT = re.compile(rf"\b([{_WORD}]{{2,}})\s+([{_WORD}]{{2,}})\b")
_CAPITALS = re.compile(rf"\b[{_UPPER}][\w-]*(?:\s+[{_UPPER}][\w-]*)*\b")


def without_suffix(word: str, suffixes) -> str:
    """A word less the longest suffix that leaves three letters or more."""
    for x in sorted(suffixes, key=len, reverse=True):
        if word.lower().endswith(x) and len(word) > len(x) + 2 and word[0].isalpha():
            return word[: len(word) - len(x)]
    return word


def entity_candidates(question: str, stopwords: frozenset[str], suffixes=()) -> list[str]:
    """What a question may be about, in order, each once: pairs of neighbouring words as written (a word is in one
    pair only), runs of capitalised words without leading stop words, and all lower-cased pairs. A pair with a stop
    word, or of fewer than five characters, doesn't count."""
    bare = lambda w: without_suffix(w, suffixes)
    stopped = lambda w: w.lower() in stopwords or bare(w).lower() in stopwords

    def pairs(found):
        for a, b in found:
            if not stopped(a) and not stopped(b) and len(x := f"{bare(a)} {bare(b)}") >= 5:
                yield x

    out = list(pairs(_NEXT.findall(question)))
    for m in _CAPITALS.finditer(question):
        words = _WORDS.findall(m[0])
        while words and stopped(words[0]):
            words.pop(0)
        if words:
            out.append(" ".join(words))
    low = _WORDS.findall(question.lower())
    return list(dict.fromkeys([*out, *pairs(zip(low, low[1:], strict=False))]))


def question_entities(stopwords, suffixes=()):
    """The vectorised form, for lists of stop words and suffixes."""
    stop = frozenset(x.lower() for x in stopwords)

    @F.pandas_udf(_STRINGS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: entity_candidates(x or "", stop, suffixes))

    return run
