"""Dictionary terms against the names' patterns, one by one."""

import random
import re
import unicodedata

from quarryspark.operators import dictionary as D
from quarryspark.plans import QUERIES

TEXTS = [
    "Az ÁRVÍZTŰRŐ  \n tükörfúrógép meg az arvizturo tukorfurogep.",
    "josé JOSE josè Josépha xjose jose-jose",
    "San  Marino sanmarino SAN MARINO, san-marino",
    "C++ and c++x, (C++) C#; straße STRASSE",
    "aa aa aa aaa", "", None, "   ", "K k K ſ s S İ i ı Σ σ ς",
    "Ödön ödön odon ŐDŐN ødøn",
]
ENTRIES = [(1, "Árvíztűrő tükörfúrógép", ["TÜKÖRFÚRÓGÉP", None, " "], 0.6), (2, "José", ["jose", "José"], None), (3, "San Marino", [], 0.0), (4, "C++", ["straße", "C#"], 0.9), (5, "aa aa", None, 0.8), (6, None, ["k", "s", "i", "σ"], 0.5), (7, "  ", [""], 0.5), (8, "ödön", ["Ødøn", "aa"], 0.5), (9, "Jose", None, 0.4)]


def brute(texts, entries):
    out = []
    for key, text in texts:
        for entry, name, aliases, confidence in entries:
            own = (name or "").strip()
            names = [own] if own else []
            names += [a.strip() for a in aliases or [] if a and a.strip()]
            for x in dict.fromkeys(names):
                parts = []
                for c in x:
                    base = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode().lower() if c.isalpha() else ""
                    forms = {"a": "aáÁA", "e": "eéÉE", "i": "iíÍI", "o": "oóöőÓÖŐO", "u": "uúüűÚÜŰU"}.get(base)
                    parts.append(f"[{forms}]" if forms else r"\s+" if c.isspace() else re.escape(c))
                for m in re.finditer(rf"\b{''.join(parts)}\b", text or "", re.IGNORECASE):
                    out.append((key, str(entry), x, m[0], m.start(), m.end(), confidence or 0.8, " ".join(unicodedata.normalize("NFKC", own or x).lower().split())))
    return sorted(out)


def found(spark, texts, entries, **other):
    docs = spark.createDataFrame(texts, "id long, text string")
    terms = spark.createDataFrame(entries, "entry long, name string, aliases array<string>, confidence double")
    return sorted(tuple(r) for r in D.find_terms(docs, "id", "text", terms, **other).collect())


def test_against_patterns(spark):
    texts = list(enumerate(TEXTS))
    wanted = brute(texts, ENTRIES)
    assert len(wanted) > 25 and {w[1] for w in wanted} >= {"1", "2", "3", "5", "6", "8", "9"}
    assert found(spark, texts, ENTRIES) == wanted
    assert found(spark, texts, ENTRIES, most_bytes=100) == wanted  # in several parts


def test_random_texts(spark):
    r = random.Random(3)
    letters = "aáAeéoöŐuxyXY  \n-"
    word = lambda n: "".join(r.choice(letters) for _ in range(r.randrange(1, n)))
    texts = [(k, word(60)) for k in range(60)]
    entries = [(k, word(5), [word(3), word(4)], 0.5) for k in range(60)]
    assert found(spark, texts, entries) == brute(texts, entries)


def test_folding_of_every_character():
    """A character of a text folds to a letter's form just where the letter's pattern takes it."""
    for letter in "aeioukszñłσμ":
        pattern = re.compile(f"[{D.VOWELS[letter]}]" if letter in D.VOWELS else re.escape(letter), re.IGNORECASE)
        for code in range(0x20, 0x3000):
            if pattern.fullmatch(chr(code)):
                assert chr(code).translate(D._TABLE) == D.folded_name(letter)


def test_plain_terms(spark):
    docs = [(1, "abcabcab"), (2, "ABC")]
    assert found(spark, docs, [(1, "abc", ["bca"], None), (2, "cab", [], None)], words=False) == sorted([(1, "1", "abc", "abc", 0, 3, 0.8, "abc"), (1, "1", "abc", "abc", 3, 6, 0.8, "abc"), (1, "1", "bca", "bca", 1, 4, 0.8, "abc"), (1, "1", "bca", "bca", 4, 7, 0.8, "abc"), (1, "2", "cab", "cab", 2, 5, 0.8, "cab"), (1, "2", "cab", "cab", 5, 8, 0.8, "cab")])


def test_empty_dictionary(spark):
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [], [(1, "a", [], None)]) == []


def test_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    terms = spark.createDataFrame([(1, "a", [], None)], "entry long, name string, aliases array<string>, confidence double")
    assert "Exchange" not in D.find_terms(docs, "id", "text", terms)._jdf.queryExecution().executedPlan().toString()


def dictionary_mentions(spark, folder):
    """The query over whole tables; called with the other brute-force versions."""
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    entries = []
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = re.split(r"\s+", r.text)
        at = [w[2] if len(w) > 2 else None, w[3][:1].upper() + w[3][1:].lower() if len(w) > 3 else None]
        entries.append((r.item_id, " ".join(w[:2]).upper(), at, r.item_id % 5 / 10 if r.item_id % 5 else None))
    got = sorted(tuple(r) for r in QUERIES["dictionary_mentions"](spark, folder).collect())
    assert got == brute(texts, entries) and len(got) > 100


def test_candidates_inside_words_need_no_pattern(monkeypatch):
    """Hits equal those of the patterns at every place; a candidate inside a word is never handed to one."""
    import re

    names = [(k, n) for k, n in enumerate(["ab", "AB", "a b", "-a", "a-", "_a", "ő", "a.", ".", "b"])]
    texts = ["ab abab xab ab_ ab-ab", "a \t b a  b\na", " -a--a a- x-a", "_a __a a_a", "Ő őo. ó", "a. a.. .a ...", "", "b", "²b b² b́"]
    for text in texts:
        wanted = []
        for k, n in names:
            end = 0
            for at in range(len(text)):
                if at >= end and (hit := D.name_pattern(n).match(text, at)):
                    wanted.append((k, at, hit.end()))
                    end = hit.end()
        assert sorted(D.Finder(names)(text)) == sorted(wanted), text
    tried = []
    real = D.name_pattern
    monkeypatch.setattr(D, "name_pattern", lambda n: tried.append(n) or real(n))
    assert D.Finder([(1, "ab"), (2, "ab")])("xab abx ab") == [(0, 8, 10), (1, 8, 10)] and tried == ["ab"]
    assert re.findall(r"\bab\b", "xab abx ab") == ["ab"]
