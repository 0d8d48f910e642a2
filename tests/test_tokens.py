"""Tokens that a corpus' values share over all texts, runs and ways back."""

from pyspark.sql import functions as F

from quarryspark.operators import tokens as P

TEXTS = [
    (1, "kb1", "Írj ide: anna@x.hu vagy 1234567, anna@x.hu!"),
    (2, "kb1", "anna@x.hu 🙂 és bela@x.hu"),
    (3, "kb2", "anna@x.hu"),
    (4, None, "7654321 meg 7654321"),
    (5, "kb1", "nothing here [email_1] and [x_9]"),
    (6, "kb1", None), (7, "kb1", ""), (1, "kb1", "1234567"), (1, "kb1", "1234567"), (None, "kb1", "+36 30 123 4567 bela@x.hu"),
    (8, "kb1", "11111111" * 400 + "@" + " word" * 3000 + " last@x.hu"),
]
SHAPE = "id long, kb string, text string"


def run(spark, texts, known=None):
    docs, tokens = P.depersonalise(spark.createDataFrame(texts, SHAPE), "id", "text", "kb", known)
    return docs, tokens


def test_equal_values_share_a_token_over_all_texts(spark):
    docs, tokens = run(spark, TEXTS)
    table = {(r.corpus, r.kind, r.value): r.token for r in tokens.collect()}
    assert len({(c, t) for (c, _, _), t in table.items()}) == len(table)
    anna, bela = table["kb1", "email", "anna@x.hu"], table["kb1", "email", "bela@x.hu"]
    found = {(r.id, r.text): r.encoded for r in docs.collect()}
    assert len(found) == len(TEXTS) - 1 and docs.count() == len(TEXTS)  # two rows are equal
    assert found[TEXTS[0][0], TEXTS[0][2]] == f"Írj ide: {anna} vagy {table['kb1', 'number', '1234567']}, {anna}!"
    assert found[2, TEXTS[1][2]] == f"{anna} 🙂 és {bela}"
    assert found[3, "anna@x.hu"] == "[email_1]" and found[4, TEXTS[3][2]] == "[number_1] meg [number_1]"
    assert found[6, None] is None and found[7, ""] == ""
    for corpus, kind in {k[:2] for k in table}:
        numbers = sorted(int(t.split("_")[-1][:-1]) for (c, k, _), t in table.items() if (c, k) == (corpus, kind))
        assert numbers == list(range(1, len(numbers) + 1))


def test_every_text_comes_back(spark):
    docs, tokens = run(spark, TEXTS)
    back = P.restored(docs, "id", "encoded", "kb", tokens).collect()
    assert len(back) == len(TEXTS) and all(r.restored.text == r.text for r in back)
    for r in back:
        assert all(r.text[s.start : s.end] == s.value for s in r.restored.spans)


def test_tokens_stay_in_the_next_run(spark):
    _, first = run(spark, TEXTS)
    kept = {(r.corpus, r.kind, r.value): r.token for r in first.collect()}
    _, second = run(spark, [(9, "kb1", "new@x.hu anna@x.hu"), (10, "kb3", "anna@x.hu"), (11, None, "999999999")], first)
    now = {(r.corpus, r.kind, r.value): r.token for r in second.collect()}
    assert {k: now[k] for k in kept} == kept and len(now) == len(kept) + 3
    emails = sum(k[:2] == ("kb1", "email") for k in kept)
    assert now["kb1", "email", "new@x.hu"] == f"[email_{emails + 1}]"
    assert now["kb3", "email", "anna@x.hu"] == "[email_1]" and now[None, "number", "999999999"] == "[number_2]"


def test_only_allowed_tokens_are_restored(spark):
    tokens = spark.createDataFrame([("kb-1", "person", "John Smith", 1, "[person_1]"), ("kb-1", "email", "j@x.org", 5, "[email_5]"), ("kb-2", "email", "z@x.org", 7, "[email_7]")], "corpus string, kind string, value string, number long, token string")
    cases = [
        (["[person_1]"], "John Smith és [email_5] [email_7]"),
        ([" [person_1] ", "[email_5]"], "John Smith és j@x.org [email_7]"),
        ([], "[person_1] és [email_5] [email_7]"),
        (None, "John Smith és j@x.org [email_7]"),  # another corpus' token stays
    ]
    docs = spark.createDataFrame([(k, "kb-1", "[person_1] és [email_5] [email_7]", a) for k, (a, _) in enumerate(cases)], "id long, kb string, text string, allowed array<string>")
    found = {r.id: r.restored for r in P.restored(docs, "id", "text", "kb", tokens, F.col("allowed")).collect()}
    assert [found[k].text for k in range(4)] == [x for _, x in cases]
    assert [tuple(s) for s in found[0].spans] == [(0, 10, "person", "John Smith", "[person_1]")]


def test_no_texts(spark):
    docs, tokens = run(spark, [])
    assert docs.count() == tokens.count() == 0


def test_spans_and_values_by_pieces(spark):
    """More texts than a piece holds, nulls and empty ones among them; whole batches aren't Python's objects."""
    texts = [None, "", *[f"a{k}@b.hu és {100_000 + k} ő" for k in range(3 * P.PIECE + 5)], *[None] * P.PIECE]
    docs = spark.createDataFrame([(k, "c", x) for k, x in enumerate(texts)], "k int, corpus string, text string").coalesce(1)
    spans = {r.k: [tuple(s) for s in r.s] for r in docs.select("k", P.personal_spans("text").alias("s")).collect()}
    assert spans == {k: P.spans_of(x or "") for k, x in enumerate(texts)}
    encoded, tokens = P.depersonalise(docs, "k", "text", "corpus")
    back = P.restored(encoded, "k", "encoded", "corpus", tokens).select("k", "tokens", "restored.*").collect()
    assert {r.k: r.text for r in back} == dict(enumerate(texts)) and all(len(r.spans) == r.tokens for r in back)
    assert not hasattr(P, "pd")
