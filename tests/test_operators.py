from pyspark.sql import functions as F

from quarryspark.functions import billing as B
from quarryspark.functions import folds
from quarryspark.functions import text as X
from quarryspark.operators import aggregates as A
from quarryspark.operators import cleaning
from quarryspark.operators import knowledge as K
from quarryspark.operators import ordered as O
from quarryspark.operators.networks import in_networks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cleaning_chain(spark):
    texts = ["a\t\tb   c\n\n\n\n\nd  ", "body one\n1\n- 2 -\npage 3\n4/10\nbody two", "HEAD\nx\nHEAD\ny\nHEAD\nz", "same\nsame\nother", "", "\n\n", "a\r\nb\rc d​"]
    rows = cleaning.normalise(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "out")
    assert [r.out for r in rows.orderBy("i").collect()] == ["a b c\n\nd", "body one\nbody two", "x\ny\nz", "same\nother", "", "", "a\nb\nc d"]
    counts = cleaning.normalisation_counts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "i", "text").orderBy("i").collect()
    assert (counts[1].page_numbers, counts[2].repeated, counts[3].consecutive) == (4, 3, 1)


def test_block_types(spark):
    cases = {"Warning: hot": "warning", "Note: this": "note", "Q: why": "faq", "a | b | c\nd | e | f": "table", "1. one\n2. two": "step", "- one\n- two": "list", "INTRODUCTION": "heading", "2.1 Scope of it": "heading", "A long sentence that goes on and on, and ends here with a stop.": "paragraph", "  ": "unknown"}
    for text, kind in cases.items():
        assert one(spark, X.block_type(F.lit(text), F.lit(False))) == kind
    assert one(spark, X.block_type(F.lit("Title line"), F.lit(True))) == "title"


def test_content_types(spark):
    assert one(spark, X.content_type(F.lit("1. open it")))["content_type"] == "process"
    assert one(spark, X.content_type(F.lit("nothing here"))).asDict() == {"content_type": "general_text", "confidence": 0.45}
    assert one(spark, X.content_type(F.lit("x"), F.lit("table"))).asDict() == {"content_type": "table", "confidence": 0.92}


def test_identifiers_and_dates(spark):
    got = one(spark, X.identifiers(F.lit("mail a.b@x.org or https://x.org/a?b=1, ticket AB-12, INV-2024-7")))
    assert {(r.kind, r.name) for r in got} >= {("email", "a.b@x.org"), ("url", "https://x.org/a?b=1"), ("ticket_id", "AB-12"), ("invoice_number", "INV-2024-7")}


def test_overlapping_parts():
    text = " ".join(f"word{i}." for i in range(900))
    parts = folds.split_overlapping(text)
    assert all(0 < len(p) <= folds.PART for p in parts) and len(parts) > 3
    for a, b in zip(parts, parts[1:], strict=False):
        assert set(a.split()[-10:]) & set(b.split()[:40])
    assert folds.split_overlapping("short") == ["short"]


def test_packing(spark):
    blocks = [(1, 0, "Title", "heading"), (1, 1, "x" * 50, "paragraph"), (1, 2, "y" * 1790, "paragraph"), (1, 3, "a|b|c", "table"), (1, 4, "z" * 10, "paragraph"), (1, 5, "w" * 300, "paragraph")]
    got = O.pack_blocks(spark.createDataFrame(blocks, "d int, o int, t string, k string"), "d", "o", "t", "k").orderBy("chunk").collect()
    assert [r.kinds for r in got] == [["heading", "paragraph"], ["paragraph"], ["table"], ["paragraph", "paragraph"]]
    short = [(1, 0, "x" * 1000, "paragraph"), (1, 1, "H", "heading"), (1, 2, "y" * 20, "paragraph")]
    got = O.pack_blocks(spark.createDataFrame(short, "d int, o int, t string, k string"), "d", "o", "t", "k").collect()
    assert len(got) == 1


def test_heading_paths(spark):
    lines = [(1, 0, 1, "A"), (1, 1, None, "text"), (1, 2, 2, "B"), (1, 3, 3, "C"), (1, 4, 2, "D"), (1, 5, 1, "E")]
    got = O.heading_paths(spark.createDataFrame(lines, "d int, o int, l int, t string"), "d", "o", "l", "t").orderBy("o").collect()
    assert [r.path for r in got] == [["A"], ["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"]]


def test_overlaps_and_admission(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 8), (1, 8, 20), (1, 20, 22)], "d int, s long, e long")
    got = O.without_overlaps(spans, ["d"], "s", "e", [-(F.col("e") - F.col("s")), F.col("s")]).collect()
    assert sorted((r.s, r.e) for r in got) == [(5, 8), (8, 20), (20, 22)]
    files = spark.createDataFrame([("b", 1, 60), ("b", 2, 50), ("b", 3, 40)], "b string, i long, n long")
    assert [r.fits for r in O.admitted(files, "b", "i", "n", 100).orderBy("i").collect()] == [True, False, True]


def test_context_budget(spark):
    hits = spark.createDataFrame([(1, k, k, "x" * 1500) for k in range(1, 9)] + [(1, 9, 1, "x")], "q int, rank int, key int, text string")
    got = O.context_blocks(hits, ["q"], "rank", "text", "key").orderBy("block").collect()
    assert [r.used for r in got] == [1500, 1500, 1000, 120, 120, 120]


def test_networks(spark):
    ips = spark.createDataFrame([("10.1.2.3",), ("10.2.0.1",), ("300.1.1.1",), (None,)], "ip string")
    nets = spark.createDataFrame([("10.1.0.0/16",), ("10.0.0.0/8",), ("10.2.0.1",)], "net string")
    got = {(r.ip, r.net) for r in in_networks(ips, "ip", nets, "net").collect()}
    assert got == {("10.1.2.3", "10.1.0.0/16"), ("10.1.2.3", "10.0.0.0/8"), ("10.2.0.1", "10.0.0.0/8"), ("10.2.0.1", "10.2.0.1")}


def test_networks_as_in_the_standard_library(spark):
    import ipaddress
    import random

    rng = random.Random(5)
    v4 = [str(ipaddress.ip_address(rng.choice([0x0A000000, 0xC0A80000]) + rng.randrange(1 << 12))) for _ in range(60)]
    v6 = [ipaddress.ip_address((rng.choice([0x20010DB8, 0xFE80, 0]) << 96) + (rng.randrange(8) << rng.choice([0, 16, 48, 64, 80]))) for _ in range(60)]
    odd = ["::", "::1", "1::", "::ffff:10.0.0.1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", ":::", "1::2::3", "1:2", "12345::", "::1.2.3", "1:2:3:4:5:6:7:8:9", ":1::", "g::", "01.2.3.4", "1.2.3.256", "10.0.0.0/8", " ::1 ", "host", "", "1:2:3:4:5:6:7:", "::1.2.3.4:5"]
    ips = [*v4, *(rng.choice([str(x), x.exploded.upper()]) for x in v6), *odd]
    nets = [f"{x}/{rng.randrange(33)}" for x in v4[:15]] + [f"{x}/{rng.randrange(129)}" for x in v6[:25]] + odd[:-4] + ["host", "10.0.0.0/255.0.0.0", "10.0.0.0/0.0.255.255", "10.0.0.0/255.0.255.0", "10.0.0.0/33", "::/129", "::/0", "0.0.0.0/0.0.0.0", "1.2.3.4/", "1.2.3.4/8/8", "::/255.0.0.0"]

    def holds(ip, net):
        ip, net = ip.strip(), net.strip()
        try:
            address = ipaddress.ip_address(ip)
        except ValueError:
            return ip != "" and ip == net
        try:
            return address in ipaddress.ip_network(net, strict=False)
        except ValueError:
            return False

    frames = spark.createDataFrame(sorted({(x,) for x in ips}), "ip string"), spark.createDataFrame(sorted({(x,) for x in nets}), "net string")
    got = sorted((r.ip, r.net) for r in in_networks(frames[0], "ip", frames[1], "net").collect())
    assert got == sorted((a, b) for a in set(ips) for b in set(nets) if holds(a, b))


def test_topic_rules(spark):
    rows = spark.createDataFrame([(1, "the invoices are due", ["INVOICE", "due"]), (2, "voice", []), (3, None, ["due"]), (4, "due", None), (5, None, None)], "id int, x string, k array<string>")
    got = {(r.id, r.topic): r.hits for r in K.match_topic_rules(rows, "id", F.col("x"), F.col("k"), {"billing": ("invoice", "due"), "other": ("oice",)}).collect()}
    assert got == {(1, "billing"): 4, (1, "other"): 1, (2, "other"): 1, (3, "billing"): 1, (4, "billing"): 1}


def test_json_that_cannot_be_read(spark):
    rows = spark.createDataFrame([(1, '{"token": "x", "b": [1]}'), (2, "{no"), (3, None), (4, '"\\ud800"'), (5, "[" * 100_000)], "id int, j string")
    got = {r.id: (r.h is None, r.r) for r in rows.select("id", folds.canonical_json_hash("j").alias("h"), folds.redacted_json("j").alias("r")).collect()}
    assert got == {1: (False, '{"token": "***", "b": [1]}'), 2: (True, None), 3: (True, None), 4: (True, None), 5: (True, None)}


def test_histogram_counts_once(spark):
    got = A.cumulative_histogram(spark.createDataFrame([(12.0,), (30.0,)], "v double"), "v", [10, 25, 50]).collect()
    assert {r.le: r.n for r in got} == {"10": 0, "25": 1, "50": 2, "+Inf": 2}


def test_billing_rules(spark):
    day = lambda d: F.lit(d).cast("date")
    assert str(one(spark, B.due_day(day("2024-10-20")))) == "2024-10-07"  # the fifth is a Saturday
    assert one(spark, B.period_key(day("2024-10-06"))) == "2024-09"
    assert one(spark, B.period_price(F.lit(1999), F.lit("yearly"))) == 20300
    assert one(spark, B.storage_gb(F.lit(0))) == 0 and one(spark, B.storage_gb(F.lit(1))) == 1
    assert one(spark, B.usage_percent(F.lit(2), F.lit(5))) == 40


def test_text_scalars(spark):
    assert one(spark, X.mask_email(F.lit("someone@x.org"))) == "s******@x.org"
    assert one(spark, X.fold_accents(F.lit("Árvíztűrő"))) == "Arvizturo"
    assert one(spark, X.close_words(F.lit("abc"), F.lit("abd"))) and not one(spark, X.close_words(F.lit(""), F.lit("a")))
    assert one(spark, X.origin(F.lit("HTTPS://X.org:8080/a"))) == "https://x.org:8080"
    assert one(spark, X.normal_form("NFKC")(F.lit("ﬁ"))) == "fi"


def test_python_folds():
    assert folds.redact_nested({"a": [{"password": "x", "b": 1}]}) == {"a": [{"password": "***", "b": 1}]}
    assert folds.pack_sentences("One is here now. " * 100)[0].count("One") > 10


def test_spans_kept_as_by_comparing_all(spark):
    import random

    r = random.Random(3)
    rows = [(d, s, s + r.randrange(0, 9)) for d in (None, 1, 2) for s in [r.randrange(60) for _ in range(80)]] + [(3, None, 4), (3, 5, 2), (3, 1, None)]
    spans = spark.createDataFrame(rows, "d int, s long, e long").repartition(3)
    got = O.without_overlaps(spans, ["d"], "s", "e", [-(F.col("e") - F.col("s")), F.col("s")]).collect()
    wanted = []
    for d in (None, 1, 2):
        kept = []
        for s, e in sorted(((s, e) for g, s, e in rows if g == d), key=lambda x: (x[0] - x[1], x[0], x[1])):
            if not any(s < b and a < e for a, b in kept):
                kept.append((s, e))
        wanted += [(d, s, e) for s, e in kept]
    order = lambda x: (x[0] or 0, x[1], x[2])
    assert sorted(map(tuple, got), key=order) == sorted(wanted, key=order)


def test_chunks_of_odd_blocks(spark):
    blocks = [(1, 0, "a", None), (1, 1, "b", "text"), (1, 2, None, "text"), (1, 3, "T", "table"), (1, 4, "c", "text"), (None, 0, "x" * 1800, "text"), (None, 1, "y", "text"), (2, 0, "h", "heading"), (2, 1, "z", "text")]
    got = O.pack_blocks(spark.createDataFrame(blocks, "d int, o int, t string, k string").repartition(2), "d", "o", "t", "k").collect()
    assert sorted(((r.d or 0), r.chunk, r.texts, r.length) for r in got) == [(0, 0, ["x" * 1800], 1800), (0, 1, ["y"], 1), (1, 0, ["a", "b", ""], 2), (1, 1, ["T"], 1), (1, 2, ["c"], 1), (2, 0, ["h", "z"], 2)]
    empty = spark.createDataFrame([], "d int, o int, t string, k string")
    assert O.pack_blocks(empty, "d", "o", "t", "k").count() == 0
