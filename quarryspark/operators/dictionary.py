"""Dictionary terms in texts: names and aliases, blind to case and to the accents of vowels, found in one pass.

The names are an Aho-Corasick automaton over folded text; a place in folded text is led back to its offsets in the original,
and each hit is verified there by the name's own pattern. The automaton goes to the tasks, and texts are neither shuffled nor exploded
into words. A dictionary beyond a bound of measured bytes is cut into parts, one pass of the texts for each."""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import measured_bytes

#: Measured bytes of entries up to which they are one automaton; an automaton takes some twenty times as many.
AUTOMATON_BYTES = 4 << 20
#: Hits that leave a task at once.
HITS = 20_000
# The forms of a vowel that stand for each other, and the confidence of an entry that states none.
VOWELS = {"a": "aáÁA", "e": "eéÉE", "i": "iíÍI", "o": "oóöőÓÖŐO", "u": "uúüűÚÜŰU"}
CONFIDENCE = 0.8
_FORMS = {form.lower(): base for base, forms in VOWELS.items() for form in forms}


class _Folded(dict):
    """For ``str.translate``: one character for each, case and vowels' accents gone, white space a blank."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        up = c.upper()
        low = (up if len(up) == 1 else c).lower()[0]
        self[code] = " " if c.isspace() else _FORMS.get(low, low)
        return self[code]


_TABLE = _Folded()


def _base(letter: str) -> str:
    return unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode().lower() if letter.isalpha() else ""


def folded_name(name: str) -> str:
    """A name as it is looked for in folded text: any accented vowel is its base, white space a single blank."""
    return re.sub(r"\s+", " ", "".join(b if (b := _base(c)) in VOWELS else c.translate(_TABLE) for c in name))


@functools.lru_cache(50_000)
def name_pattern(name: str) -> re.Pattern[str]:
    """The pattern of a name as a word of its own: each vowel in any of its forms, white space of any length."""
    parts = [f"[{VOWELS[b]}]" if (b := _base(c)) in VOWELS else r"\s+" if c.isspace() else re.escape(c) for c in name]
    return re.compile(rf"\b{''.join(parts)}\b", re.IGNORECASE)


def folded_text(text: str) -> tuple[str, np.ndarray | None]:
    """Folded text with single blanks, and the original place of each of its characters (none if they are the same)."""
    whole = text.translate(_TABLE)
    if "  " not in whole:
        return whole, None
    codes = np.array([*whole])
    kept = np.flatnonzero((codes != " ") | np.concatenate([[True], codes[:-1] != " "]))
    return "".join(codes[kept]), kept


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _parts(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place, as a pattern's ``\\b`` has it."""
    return (at > 0 and _word(text[at - 1])) != (at < len(text) and _word(text[at]))


class Finder:
    """``names``: (entry, name) pairs. With ``words`` a name is found as a word of its own, in all its forms; without, as the very
    same characters anywhere."""

    def __init__(self, names: list[tuple[object, str]], words: bool = True):
        self.names, self.words, self.automaton = names, words, ahocorasick.Automaton()
        by_text: dict[str, list[int]] = {}
        for k, (_, name) in enumerate(names):
            by_text.setdefault(folded_name(name) if words else name, []).append(k)
        for text, places in by_text.items():
            self.automaton.add_word(text, (len(text), places))
        if by_text:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(name's number, start, end) of all hits; hits of one name don't overlap, the first one holds."""
        if not len(self.automaton):
            return []
        if not self.words:
            return self._as_they_are(text)
        seen, back = folded_text(text)
        places = back.tolist() if back is not None else range(len(text))
        near = []
        for last, (n, numbers) in self.automaton.iter(seen):
            start, end = places[last - n + 1], places[last] + 1
            # A hit of the pattern has just these edges; most candidates lie inside of words.
            if _parts(text, start) and _parts(text, end):
                near += [(start, k) for k in numbers]
        near.sort()
        ends: dict[int, int] = {}
        out, now, met = [], -1, {}
        for start, k in near:
            if start < ends.get(k, 0):
                continue
            if start != now:
                now, met = start, {}
            name = self.names[k][1]
            if name not in met:  # entries that share a name share its hit
                met[name] = (hit := name_pattern(name).match(text, start)) and hit.end()
            if met[name]:
                ends[k] = met[name]
                out.append((k, start, ends[k]))
        return out

    def _as_they_are(self, text: str) -> list[tuple[int, int, int]]:
        ends: dict[int, int] = {}
        out = []
        for start, k in sorted((last - n + 1, k) for last, (n, numbers) in self.automaton.iter(text) for k in numbers):
            if start >= ends.get(k, 0):
                ends[k] = start + len(self.names[k][1])
                out.append((k, start, ends[k]))
        return out


def find_terms(docs: DataFrame, key: str, text: str, entries: DataFrame, words: bool = True, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, entry, name, raw, start, end, confidence, normalized) of all names of ``entries`` (entry: any id; name; aliases: array; confidence)
    in the texts; offsets count characters from 0.

    Null or blank names and aliases aren't looked for, a name that an entry has twice is looked for once, and names that several entries have are
    found for each; a null or zero confidence is the default one. A null text has no hits; rows of the same key are searched apart."""
    schema = dict(docs.dtypes)
    size = measured_bytes(entries)
    parts = max(1, math.ceil(size / most_bytes))
    named = entries.select(F.col("entry").cast("string").alias("entry"), F.col("name"), F.col("aliases"), F.col("confidence").cast("double").alias("confidence"))
    shape = f"`{key}` {schema[key]}, entry string, name string, raw string, start int, end int, confidence double, normalized string"

    def searched(some: DataFrame) -> DataFrame:
        names, told = [], []
        for r in some.collect():  # of measured size
            own = (r.name or "").strip()
            for name in dict.fromkeys(x for x in (own, *((a or "").strip() for a in r.aliases or ())) if x):
                names.append((r.entry, name))
                told.append((r.confidence or CONFIDENCE, re.sub(r"\s+", " ", unicodedata.normalize("NFKC", own or name).lower().strip())))
        sent = docs.sparkSession.sparkContext.broadcast((names, told))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, told = sent.value
            finder = Finder(names, words)
            columns = [key, "entry", "name", "raw", "start", "end", "confidence", "normalized"]
            entry, name, normal = (pa.array(x, pa.string()) for x in ([n[0] for n in names], [n[1] for n in names], [t[1] for t in told]))
            confidence = pa.array([t[0] for t in told], pa.float64())
            for batch in batches:
                hits = ((row, k, x[a:b], a, b) for row, x in enumerate(v.as_py() for v in batch.column(1)) if x for k, a, b in finder(x))
                while rows := list(itertools.islice(hits, HITS)):
                    at, ks, raw, start, end = zip(*rows, strict=True)
                    k = pa.array(ks, pa.int32())
                    arrays = [batch.column(0).take(pa.array(at, pa.int32())), entry.take(k), name.take(k), pa.array(raw, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), confidence.take(k), normal.take(k)]
                    yield pa.RecordBatch.from_arrays(arrays, names=columns)

        return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, shape)

    found = [searched(named.where(F.pmod(F.xxhash64("entry", "name"), F.lit(parts)) == k) if parts > 1 else named) for k in range(parts)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
