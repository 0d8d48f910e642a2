"""Encoding and decoding against the tokenizers library, and trees against plain scans."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
from support import DATA
from tokenizers import Tokenizer

from quarryspark.llm import bpe
from quarryspark.llm.queries import op12_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary(PATH))


def ids(encoder, texts):
    return [list(array("I", x)) for x in encoder.encode(texts)]


def test_every_code_point(encoder, library):
    """Class, case, order of marks and composition of each character, between letters, digits and marks."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}B '{chr(c)}1 {chr(c)}́ q́{chr(c)}̖" for c in points]
    for start in range(0, len(texts), 50_000):
        some = texts[start : start + 50_000]
        assert ids(encoder, some) == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


def test_random_texts(encoder, library):
    r = random.Random(1)
    letters = [*"abcdeé'stΣς ́̀각ͅ0１\n\t $#", "<|endoftext|>", "<|startoftext|>", "<|end", "'LL", "\U0001f600", "࢏", "\U0001e4ec"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(5000)]
    assert ids(encoder, texts) == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_decoding(encoder, library):
    for text in ("", "Hello, wörld's end<|endoftext|>x", "ΣΑΣ 123"):
        found = ids(encoder, [text])[0]
        assert bpe.decode_ids(encoder.encode([text])[0], encoder.vocabulary.tokens) == library.decode(found, skip_special_tokens=False)


def test_very_long_words(encoder, library):
    for text in ("ab" * 30_000, "a" * 50_001, "$" * 20_000, "é" * 10_000 + "x"):
        assert ids(encoder, [text])[0] == library.encode(text, add_special_tokens=False).ids


def test_trees_equal_scans():
    """Any merges, not only those of a trained vocabulary: lowest rank first, leftmost of equal ones."""
    r = random.Random(2)
    for _ in range(60):
        merges, n = {}, 4
        for rank in range(r.randrange(1, 12)):
            merges.setdefault(r.randrange(n) << 20 | r.randrange(n), rank << 20 | n)
            n += 1
        word = [r.randrange(4) for _ in range(r.randrange(1, 40))]
        want = list(word)
        while pairs := [(merges[a << 20 | b], i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False)) if (a << 20 | b) in merges]:
            best, i = min(pairs)
            want[i : i + 2] = [best & ((1 << 20) - 1)]
        assert bpe.merged(word, merges) == want
        vocabulary = bpe.Vocabulary([], {}, "", list(range(256)), list(range(256)), merges, "")
        together = bpe.merged_many([bytes(word), bytes(word[:1]), bytes(word[::-1])], vocabulary, bpe.Pairs(merges))
        assert list(array("I", together[0])) == want


def test_memory_is_bounded(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    small = bpe.Encoder(encoder.vocabulary)
    texts = ["one two three four", "five six seven eight nine ten", "one ten"]
    for text in texts:
        assert ids(small, [text])[0] == library.encode(text, add_special_tokens=False).ids
    assert len(small.words) <= 6


def expected(library, text):
    found = library.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(k.to_bytes(4, "little") for k in found)
    return len(found), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(found, skip_special_tokens=False).encode()).hexdigest()


def test_query_on_whole_documents(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = op12_bpe(spark, DATA).collect()
    assert len(found) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id]) for r in found)


def test_odd_rows(spark, odd, none, library, monkeypatch):
    """Nulls, blanks, repeats, a very long text; other columns stay, also with clashing names; batches of one text."""
    monkeypatch.setattr(bpe, "BATCH_BYTES", 50)
    clash = odd.withColumnsRenamed({"n": "a.b", "words": "decoded", "score": "text`s"})
    coded = bpe.encode(clash, PATH)
    assert coded.columns == [*clash.columns, "ids"]
    found = bpe.decode(coded, PATH).collect()
    assert sorted(str((r.doc_id, r.text)) for r in found) == sorted(str((r.doc_id, r.text)) for r in odd.collect())
    for r in found:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(array("I", bytes(r.ids))) == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
