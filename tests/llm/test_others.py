"""Operators on conversations, pages and embeddings: brute force, and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from support import DATA, same_rows
from pyspark.sql import functions as F

from quarryspark.llm import ann, chat, htmltext, queries, urlrules


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name]))


# --- chat -----------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    r = random.Random(1)
    bits = ["<|im_start|>", "<|im_end|>", "<|", "|>", "\\", "\\\\", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<", "[", "\n", "é", "x ", "<|im_part|>", "<|im_sep|>", ""]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "tool<|", None]), r.choice([None, "".join(r.choices(bits, k=6))]), 1) for c in range(40) for t in range(r.randrange(1, 8) if c else 400)]
    rows += [(None, 1, "user", "a", 1), (None, None, "user", "b", 1), (99, 1, "user", "same", 1), (99, 1, "user", "same", 1)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rows int"))
    read = {x.conv_id: x for x in made.select("conv_id", "formatted", "mask", chat.turns(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("mask")).alias("l")).collect()}
    for c in {x[0] for x in rows}:
        own = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(x.role, x.text) for x in read[c].t] == [(x[2] or "", x[3] or "") for x in own]
        assert read[c].l == "".join(x[3] or "" for x in own if x[2] == "assistant")
        spans = [read[c].formatted[m.start - 1 : m.start - 1 + m.length] for m in read[c]["mask"]]
        assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in spans] == [x[3] or "" for x in own if x[2] == "assistant"]
        bare = read[c].formatted
        for mark in ("<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>"):
            bare = bare.replace(mark, "\0")
        assert not any(m in bare for m in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_merges_neighbours(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert made.first().formatted == "<|im_start|>user<|im_sep|>a<|im_part|>b<|im_end|>\n<|im_start|>assistant<|im_sep|>c<|im_end|>\n"
    d = chat.digests(made).first()
    assert d.n_turns == 3 and d.turns_sha256 == hashlib.sha256(b"user\na\nuser\nb\nassistant\nc\n").hexdigest() and d.loss_chars == 1


# --- url rules ------------------------------------------------------------------------------------------------


def test_urls_against_brute_force(spark):
    r = random.Random(4)
    label, seg = ["a", "b", "c", "www"], ["/", "/x", "/x/", "/x/y", "/y/", ""]
    rules = {(".".join(r.choices(label, k=r.randrange(1, 4))), r.choice(seg)): r.choice(["allow", "block"]) for _ in range(40)} | {("", "/x/y"): "block"}
    urls = [f"http://{'.'.join(r.choices(label, k=r.randrange(1, 5))).upper() if r.random() < 0.3 else '.'.join(r.choices(label, k=r.randrange(1, 5)))}{r.choice(seg)}{r.choice(['', '?q=/x/', '#f'])}" for _ in range(600)]
    urls += ["http://a.b" + "/x"] * 500 + [None, "", "no scheme", "http://", "://a/x", "http://a.b:80/x"]
    table = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {x.page_id: x for x in urlrules.judge(table, spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(x) for x in "/?#" if x in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.index(x) for x in "?#" if x in path], default=len(path))]
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h) or h == "") and path.startswith(p)]
        best = max(fits) if fits else (0, 0, None, "allow")
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, best[2], best[3])


def test_urls_without_rules_or_rows(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    table = spark.createDataFrame([(1, "http://a/x")], "page_id long, url string")
    assert urlrules.judge(table, rules, default="block").first().verdict == "block"
    assert urlrules.judge(table.limit(0), rules).count() == 0


# --- neighbours -----------------------------------------------------------------------------------------------


def _brute(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    a = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in asked:
        s = a @ a[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours_recall(spark):
    r = np.random.default_rng(0)
    a = r.normal(size=(2000, 16)).astype(np.float32)
    a[500:800] = a[500]  # a hot vector
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(a)]
    got = {}
    for x in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=20, sample_rows=1000).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    wanted = _brute(rows, range(0, 2000, 20), 20)
    assert set(got) == set(wanted) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) / 20 for q in wanted]) >= 0.9
    assert [i for i, _ in got[520]] == [i for i, _ in wanted[520]]  # ties go to the smaller ids
    for q, hits in got.items():
        scores = dict(_brute(rows, [q], 2000)[q])
        assert all(abs(scores[i] - s) < 1e-9 for i, s in hits) and [s for _, s in hits] == sorted((s for _, s in hits), reverse=True)


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (40, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (8, [float("inf"), 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, node int, part int")
    got = ann.search(frame, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.rank, x.vec_id) for x in got] == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert ann.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.8]), (1, [0.2, 0.2])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=20).orderBy("rank").collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in got] == [(0, 1, 1, 0.9), (0, 2, 2, 0.8)]


def test_neighbours_of_small_parts(spark):
    """Tight clusters of twelve: one part never holds twenty, so queries go on."""
    r = np.random.default_rng(3)
    middles = r.normal(size=(40, 8)) * 10
    rows = [(k, [float(x) for x in middles[k % 40] + r.normal(size=8) * 0.01]) for k in range(480)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, parts=15).groupBy("query_id").count().collect()
    assert len(got) == 24 and all(x["count"] == 20 for x in got)


def test_router_deals_evenly():
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 16)) + 3 * (r.random((2000, 1)) < 0.5)
    router = ann.fit(x, 20, 16)
    assert np.bincount(router.index.order(x)[:, 0], minlength=16).max() <= 1.5 * 125
    assert ann.parts_for(10) == 1 and ann.parts_for(2_000) == 8 and ann.parts_for(50_000) == 64 and ann.parts_for(10**9) == 256


def test_parts_are_balanced():
    r = np.random.default_rng(2)
    graph = ann.neighbour_graph(r.normal(size=(1000, 8)), 10)
    part = ann.balanced_parts(graph, 8)
    assert np.bincount(part, minlength=8).max() <= 1.05 * 125 + 1
    inside = (part[graph] == part[:, None]).mean()
    assert inside > 0.3  # an eighth by chance


# --- html -----------------------------------------------------------------------------------------------------

LONG = "This is a sentence of the article, with commas, and enough length to earn points for its container."


def page(*parts):
    return "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>" + "".join(parts) + "</body></html>"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        (page("<nav><a href='/'>Home</a></nav><article><h1>Head &amp; more</h1><p>", LONG, "<p><b>two</b>\n  &#233;&nbsp;x</p></article><footer>", LONG, "</footer>"), f"Head & more\n{LONG}\ntwo é x"),
        (page("<div class='sidebar'><p>", LONG * 3, "</p></div><div id='content'><p>", LONG, "</p><p>short</p><form><p>", LONG, "</p></form></div><div class='comments'><p>", LONG * 4, "</p></div>"), f"{LONG}\nshort"),
        (page("<div class='ad'>buy</div><div><div><p>", LONG, "</p></div><p>", LONG, "</p></div>"), f"{LONG}\n{LONG}"),
        (page("<main><section><p>", LONG, "</p></section><section><p>tiny</p></section></main>"), f"{LONG}\ntiny"),
        (page("<article><p>", LONG, "</p><aside>no</aside><div class='cookie-notice'>no</div><!-- no --><ul><li>one<li>two</ul>"), f"{LONG}\none\ntwo"),
        ("<article><p>" + LONG + "<p>end &am", f"{LONG}\nend &am"),
        ("<article><p>" + LONG + "</p><p>x</p><foo", f"{LONG}\nx"),
        (page("<div class='links'>", "<a href=x>link text that is long enough, really, it is</a> " * 9, "</div><div><p>", LONG, "</p></div>"), LONG),
    ],
)
def test_extraction(html, text):
    assert htmltext.main_text(html) == text


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<p><a title=it's>two lost?</a></p><p>mid</p><p>it's three</p>", "two lost?\nmid\nit's three"),
        ('<p class="x" ">a < b, a<3 "here"</p>', 'a < b, a<3 "here"'),
        ("<p a='x>y' b=\"c>d\" c = e>one</p><p d='never ends>two", "one\ntwo"),
        ("<p class='market-share'>a</p><div class='search-results'><p>b</p></div><div class='ad top'>no</div><div class='sidebar-widget'>no</div><p hidden>no</p>", "a\nb"),
        ("<p>a <b><i>x</b> y</i> z</p><p>u<b>v<p>w</b>x</p></nope></p>", "a x y z\nuv\nwx"),
        ("<header><h2>h</h2></header><script>a<b</script><!-- no --!><p>a<br>b</p>", "h\na b"),
    ],
)
def test_extraction_inside_articles(inner, text):
    assert htmltext.main_text(f"<article><p>{LONG}</p>{inner}</article>") == f"{LONG}\n{text}"


@pytest.mark.parametrize("part", ["<div>", "<b>", "<p><b>", "<li>", "<td><tr>", "<b></i>", "<p a='x", '<p a="', "<a", "<p ", "<!--", "<script>", "<", "</", "<div class='x y'>", "</div>"])
def test_extraction_takes_linear_time(part):
    import time

    took = []
    for n in (5_000, 20_000):
        began = time.process_time()
        htmltext.main_text(part * n + LONG + ">\"'")
        took.append(time.process_time() - began)
    assert took[1] < 0.5 + 8 * took[0]


def test_extraction_against_the_standard_parser(spark):
    """All pages, with another parser: the blocks of the article."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            elif tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            if tag in ("p", "h1"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in queries.op10_html(spark, "/root/testdata/sf0.01").collect()}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html or "")
        wanted = "\n".join(x for b in parser.blocks if (x := " ".join(b.split())))
        assert got[r.page_id].text == wanted and got[r.page_id].n_chars == len(wanted) and got[r.page_id].url == r.url


def test_extraction_odd_rows(spark):
    rows = [(1, "u", None, "k"), (2, None, "<p>" * 3000 + "deep" + "<div>" * 3000 + LONG, "k"), (2, None, "<p>" * 3000 + "deep" + "<div>" * 3000 + LONG, "k"), (None, "u", "<p>" + LONG * 2000, "k")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract(frame).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got)[0] == 0 and max(r.n_chars for r in got) == len(LONG) * 2000
    assert htmltext.extract(frame.limit(0)).count() == 0
