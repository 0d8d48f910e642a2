"""Companies in texts: a legal form, and the name to the left of it.

Legal forms are one automaton for each language. Of the forms that begin at a place the longest counts that stands as a word of its own;
from there the walk goes to the left, word by word, as long as words look like parts of a name. Texts aren't shuffled."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hits that leave a task at once.
HITS = 20_000
# Common legal forms by language ("global" goes with each), words that end a walk, the longest name and word, the confidence.
FORMS = {
    "hu": ("Kft.", "Kft", "Bt.", "Bt", "Zrt.", "Zrt", "Nyrt.", "Nyrt", "Kkt.", "Kkt", "Rt.", "Rt"),
    "en": ("LLC", "LLC.", "L.L.C.", "Ltd.", "Ltd", "Limited", "Inc.", "Inc", "Corp.", "Corporation", "PLC", "LLP"),
    "es": ("S.L.", "SL", "S.L.U.", "S.A.", "SA", "Sociedad Limitada", "Sociedad Anónima"),
    "global": ("GmbH", "AG", "B.V.", "N.V.", "S.à r.l.", "Pty Ltd", "Pte. Ltd.", "SRL", "SpA"),
}
BOUNDARIES = {
    "hu": frozenset("a az és vagy hogy ha mert ügyfél partner szerződés szerződését számla kapcsolat által részére felé".split()),
    "en": frozenset("the a an and or with by for from to in on of was is are signed policy contract customer client partner".split()),
    "es": frozenset("el la los las un una y o con de del para por en contrato cliente socio empresa".split()),
}
MOST_WORDS, LONGEST_WORD, SHORTEST_NAME, CONFIDENCE = 4, 40, 3, 0.93
EDGES = ".,;:\"'()[]"
#: A capital letter saves this word from ending a walk: it begins names.
NAME_WORD = "empresa"


class Company(NamedTuple):
    name: str
    start: int
    end: int
    legal_form: str
    suffix: str
    words: list[str]
    stop: str | None
    full_form: str | None
    normalized: str


class Walk(NamedTuple):
    places: list[int]
    words: list[str]
    stop: str | None


def _goes_on(c: str) -> bool:
    """A character that makes the form before or after it a part of a longer word."""
    return c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"


class CompanyFinder:
    """``forms``, ``full``: legal forms and their full names by language; ``known``: words that are parts of names however they look."""

    def __init__(self, forms: Mapping[str, Iterable[str]] = FORMS, full: Mapping[str, Iterable[str]] | None = None, known: Iterable[str] = (), most: int = MOST_WORDS):
        self.forms = {k: [x for f in v if (x := f.strip())] for k, v in forms.items()}
        self.full = {k: list(v) for k, v in (full or {}).items()}
        self.known, self.most = frozenset(known), most
        self._of = functools.cache(self._language)
        self._full_of = functools.lru_cache(10_000)(self._full_form)

    @staticmethod
    def _own(table: Mapping[str, list[str]], language: str) -> list[str]:
        """What a language uses: its own entries and the global ones; all entries if it has none."""
        groups = [table[language], table.get("global", [])] if language in table else table.values()
        return list(dict.fromkeys(itertools.chain.from_iterable(groups)))

    def _language(self, language: str):
        forms = self._own(self.forms, language)
        automaton, canonical = ahocorasick.Automaton(), {}
        for form in forms:
            automaton.add_word(form, len(form))
            canonical.setdefault(form.casefold(), form)
        if forms:
            automaton.make_automaton()
        return automaton, canonical, BOUNDARIES.get(language or "en", BOUNDARIES["en"])

    def _full_form(self, suffix: str, language: str) -> str | None:
        return next((x for x in self._own(self.full, language) if suffix.casefold() in x.casefold()), None)

    def _suffixes(self, text: str, automaton) -> Iterator[tuple[int, int]]:
        """(start, end) of forms as words of their own, from left to right, the longest of each place; none overlaps the one before."""
        if not len(automaton):
            return
        alone = ((last - n + 1, last + 1) for last, n in automaton.iter(text) if last < n or not _goes_on(text[last - n]))
        whole = [(a, b) for a, b in alone if b == len(text) or not (text[b] == "." or _goes_on(text[b]))]
        free = 0
        for a, b in sorted(whole, key=lambda x: (x[0], -x[1])):
            if a >= free:
                free = b
                yield a, b

    def _part_of_name(self, bare: str) -> bool:
        looks = bare[0].isupper() or any(c.isdigit() or c in ".-" for c in bare)
        return len(bare) <= LONGEST_WORD and (looks or bare in self.known)

    def _walk(self, text: str, spans: list[tuple[int, int]], end: int, boundaries: frozenset[str]) -> Walk:
        """Leftwards from ``end`` while words are parts of a name."""
        at = bisect.bisect_left(spans, (end, 0)) - 1
        places: list[int] = []
        words: list[str] = []
        while at >= 0 and len(words) < self.most:
            a, b = spans[at]
            word = text[a : min(b, end)]
            bare = word.strip(EDGES)
            kept_word = bare.casefold() == NAME_WORD and bare[:1].isupper()
            if not bare or (bare.casefold() in boundaries and not kept_word):
                return Walk(places[::-1], words[::-1], bare)
            if not self._part_of_name(bare):
                break
            places.append(a)
            words.append(word)
            at -= 1
        return Walk(places[::-1], words[::-1], None)

    def __call__(self, text: str, language: str | None = None) -> Iterator[Company]:
        code = (language or "").strip().lower()
        automaton, canonical, boundaries = self._of(code)
        spans: list[tuple[int, int]] | None = None
        for start, end in self._suffixes(text, automaton):
            suffix = text[start:end]
            if not (suffix[0].isupper() or "." in suffix or "-" in suffix or suffix.isupper()):
                continue
            if spans is None:
                spans = [m.span() for m in re.finditer(r"\S+", text)]
            stop = start
            while stop and text[stop - 1].isspace():
                stop -= 1
            comma = stop > 0 and text[stop - 1] == ","
            if comma:
                stop -= 1
            found = self._walk(text, spans, stop, boundaries)
            if not found.words:
                continue
            joined = " ".join(found.words)
            name = f"{joined.rstrip(',')}, {suffix}" if comma else f"{joined} {suffix}"
            if len(name) >= SHORTEST_NAME:
                normalized = " ".join(unicodedata.normalize("NFKC", name).lower().split())
                yield Company(name, found.places[0], end, canonical[suffix.casefold()], suffix, [w.strip(EDGES) for w in found.words], found.stop or None, self._full_of(suffix, code), normalized)


SHAPE = "name string, start int, end int, legal_form string, suffix string, words array<string>, stop string, full_form string, normalized string, confidence double"


def find_companies(docs: DataFrame, key: str, text: str, language: Column | None = None, forms: Mapping[str, Iterable[str]] = FORMS, full: Mapping[str, Iterable[str]] | None = None, known: Iterable[str] = ()) -> DataFrame:
    """(key, name, start, end, legal_form, suffix, words, stop, full_form, normalized, confidence) of the companies in the texts.

    Offsets count characters from 0, up to the legal form's end; ``stop`` is the word that ended the walk, if one did. A null or unknown language
    uses all forms and English boundaries; a null or empty text has no companies; rows of one key are searched apart. ``forms``, ``full`` and
    ``known`` are lists of gazetteers, sent to the tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(({k: tuple(v) for k, v in forms.items()}, {k: tuple(v) for k, v in (full or {}).items()}, tuple(known)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = CompanyFinder(*sent.value)
        columns = [key, *Company._fields, "confidence"]
        for batch in batches:
            rows = ((k, *hit, CONFIDENCE) for k, x, code in zip(batch[key], batch["__text"], batch["__language"], strict=True) if x for hit in finder(x, code))
            while some := list(itertools.islice(rows, HITS)):
                yield pd.DataFrame(some, columns=columns)

    code = (F.lit(None) if language is None else language).cast("string")
    return docs.select(key, F.col(text).alias("__text"), code.alias("__language")).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, {SHAPE}")
