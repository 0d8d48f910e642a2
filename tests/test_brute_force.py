"""Queries that SQL doesn't express, over whole tables, against plain Python."""

import hashlib
import json
import uuid

import pytest
import regex
from pyspark.sql import functions as F
from support import DATA
from test_dictionary import dictionary_mentions

from quarryspark.functions import folds
from quarryspark.functions import text as X
from quarryspark.operators import companies as C
from quarryspark.plans import QUERIES


def rows(spark, table):
    return spark.read.parquet(f"{DATA}/{table}.parquet").collect()


def result(spark, name):
    return QUERIES[name](spark, DATA).collect()


def sentence_chunks(spark):
    got = {}
    for r in sorted(result(spark, "sentence_chunks"), key=lambda r: (r.doc_id, r.chunk)):
        got.setdefault(r.doc_id, []).append(r.text)
    assert max(len(x) for texts in got.values() for x in texts) <= 900
    for d in rows(spark, "documents"):
        now, wanted = [], []
        for s in [*regex.split(r"(?<=[.!?])\s+", " ".join((d.text or "").split())), None]:
            if s is None or now and len(" ".join([*now, s])) > 900:
                wanted.append(" ".join(now))
                now = []
            if s is not None and len(s) > 900:
                wanted += ["".join(x) for x in zip(*[iter(s)] * 900)] + [s[len(s) // 900 * 900 :]]
            elif s is not None:
                now.append(s)
        assert got.get(d.doc_id, []) == [w for w in wanted if len(w) > 20]


def canonical_payload_hash(spark):
    raw = {r.event_id: r.props for r in rows(spark, "events")}
    for r in result(spark, "canonical_payload_hash"):
        assert r.h == hashlib.sha256(json.dumps(json.loads(raw[r.event_id]), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def nested_redaction(spark):
    names = {r.c_custkey: r.c_name for r in rows(spark, "customer")}
    for r in result(spark, "nested_redaction"):
        assert json.loads(r.payload) == {"name": names[r.c_custkey], "inner": {"api_key": "***", "id": r.c_custkey}}


def depersonalised_texts(spark):
    """Numbers by the digests of a source's distinct values; the texts put together from the left."""
    found, values = {}, {}
    pattern = regex.compile(r"(?<literal>\[[a-z0-9_]+_\d+\])|(?<email>[\w.+-]+@[\w-]+\.[\w.-]+)|(?<phone>\+\d[\d \-]{7,}\d)|(?<number>\d{6,})")
    docs = rows(spark, "documents")
    for d in docs:
        found[d.doc_id] = [(m.start(), m.end(), m.lastgroup, m[0]) for m in pattern.finditer(d.text)]
        for _, _, kind, value in found[d.doc_id]:
            values.setdefault((d.source, kind), set()).add(value)
    number = {(c, k, v): n for (c, k), vs in values.items() for n, v in enumerate(sorted(vs, key=lambda v: (hashlib.md5(v.encode()).hexdigest(), v)), 1)}
    got = {r.doc_id: r for r in result(spark, "depersonalised_texts")}
    assert len(got) == len(docs) and any(len(v) > 1 for v in values.values())
    for d in docs:
        out, at = [], 0
        for a, b, kind, value in found[d.doc_id]:
            out += [d.text[at:a], f"[{kind}_{number[d.source, kind, value]}]"]
            at = b
        r = got[d.doc_id]
        assert (r.encoded, r.n_tokens, r.n_restored, r.same) == ("".join([*out, d.text[at:]]), len(found[d.doc_id]), len(found[d.doc_id]), True)


def place_mentions(spark):
    got = {}
    for r in result(spark, "place_mentions"):
        got.setdefault(r.doc_id, []).append((r.kind, r.raw))
    for d in rows(spark, "documents"):
        low, wanted = d.text.lower(), []
        wanted += [("address", m[0]) for m in regex.finditer(r"(?i)(?<![\p{L}\p{N}_])\d{4}\s[\p{L}\p{N}_.-]+\s(?:utca|út|tér|körút)\s?\d+\.?", d.text)]
        wanted += [("room", m[0]) for m in regex.finditer(r"(?i)(?<![\p{L}\p{N}_])(?:tárgyaló|meeting room)\s[\p{L}\p{N}_-]+", d.text)]
        wanted += [("office", m[0]) for m in regex.finditer(r"(?i)(?<![\p{L}\p{N}_])[\p{L}\p{N}_]+?i\s+(?:irod|telephely|raktár)[\p{L}\p{N}_]*", d.text)]
        wanted += [(k, n) for k, ns in (("city", X.CITIES), ("region", X.REGIONS)) for n in ns if n in low]
        assert sorted(got.get(d.doc_id, [])) == sorted(wanted)


def phrase_keywords(spark):
    got = {}
    for r in result(spark, "phrase_keywords"):
        got.setdefault(r.doc_id, {})[r.term] = round(r.score, 6)
    word = r"[\p{L}\p{M}\p{N}_-]{2,}"
    pattern = regex.compile(rf"(?<![\p{{L}}\p{{N}}_]){word}(?:[ \t\n\x0b\f\r]{word}){{0,2}}(?![\p{{L}}\p{{N}}_])")
    for d in rows(spark, "documents"):
        terms = {m[0] for m in pattern.finditer(d.text)}
        assert got.get(d.doc_id, {}) == {t: round(0.5 + 0.1 * len(regex.split(r"[ \t\n\x0b\f\r]", t)), 6) for t in terms}


def _names_before_forms(text, language):
    """Every place and every form by comparison; then words to the left, split anew for each place."""
    forms = [f for k, fs in C.FORMS.items() if k in (language, "global") or language not in C.FORMS for f in fs]
    bad, out, at = C.BOUNDARIES.get(language, C.BOUNDARIES["en"]), [], 0
    inside = regex.compile(r"[\p{L}\p{N}\p{M}_]").fullmatch
    while at < len(text):
        here = [f for f in forms if text.startswith(f, at) and not (at and inside(text[at - 1])) and not (text[at + len(f) : at + len(f) + 1] == "." or inside(text[at + len(f) : at + len(f) + 1]))]
        if not here:
            at += 1
            continue
        form = max(here, key=len)
        left, words = text[:at].rstrip(), []
        comma = left.endswith(",")
        left = left[:-1] if comma else left
        while len(words) < 4 and (m := regex.search(r"\S+\s*$", left)):
            word = m[0].rstrip()
            bare = word.strip(C.EDGES)
            if not bare or len(bare) > 40 or (bare.casefold() in bad and bare != "Empresa"):
                break
            if not (bare[0].isupper() or regex.search(r"[\d.-]", bare)):
                break
            words.insert(0, word)
            left = left[: m.start()]
        if words and (form[0].isupper() or "." in form):
            sep = ", " if comma else " "
            out.append((" ".join(words).rstrip("," if comma else "") + sep + form, at + len(form), form))
        at += len(form)
    return out


def company_mentions(spark):
    got = {}
    for r in result(spark, "company_mentions"):
        got.setdefault(r.doc_id, []).append((r.name, r.end, r.suffix))
    forms = ("GmbH", "AG", "S.L.", "SpA", "Ltd.", "Zrt.", "Sociedad Anónima", "gmbh")
    for d in rows(spark, "documents"):
        first = " ".join(w[:1].upper() + w[1:].lower() for w in d.text.split(" ")[:2])
        text = f"{d.text} signed by {first}{',' if d.doc_id % 3 == 0 else ''} {forms[d.doc_id % 8]} and others"
        assert got.get(d.doc_id, []) == _names_before_forms(text, d.lang)
    assert len(got) > 50


def recognised_mentions(spark):
    """Identifiers as the column functions find them, companies as above."""
    got = {}
    for r in result(spark, "recognised_mentions"):
        got.setdefault((r.doc_id, r.kind), []).append((r.subtype, r.name) if r.kind == "identifier" else r.name)
    listed = {}
    for r in result(spark, "identifier_mentions"):
        listed.setdefault((r.doc_id, "identifier"), set()).add((r.kind, r.name))
    for d in rows(spark, "documents"):
        assert set(got.get((d.doc_id, "identifier"), [])) == listed.get((d.doc_id, "identifier"), set())
        assert got.get((d.doc_id, "company"), []) == [x for x, _, _ in _names_before_forms(d.text, d.lang)]


def person_mentions(spark):
    from quarryspark.plans.recognition import GIVEN, LISTED

    got = sorted((r.doc_id, r.start, r.end, r.name, r.confidence) for r in result(spark, "person_mentions"))
    wanted = []
    for d in rows(spark, "documents"):
        at = 0
        while m := regex.compile(r"\b([A-ZÁÉÍÓÖŐÚÜŰ][\w-]+)\s+([A-ZÁÉÍÓÖŐÚÜŰ][\w-]+)\b").search(d.text, at):
            at = m.end()
            names = [m[1], m[2]] if m[1].lower() in GIVEN else [m[2], m[1]] if m[2].lower() in GIVEN else None
            if names:
                mail = regex.search(r"[\w.+-]+@[\w.-]+\.\w+", d.text[max(0, m.start() - 120) : m.end() + 120])
                sign = any(x in regex.split(r"\W+", d.text[max(0, m.start() - 200) : m.end() + 200].lower()) for x in ("üdv", "tisztelettel", "köszönettel", "sincerely", "regards", "signature"))
                wanted.append((d.doc_id, m.start(), m.end(), " ".join(names), round((0.75 if " ".join(names).lower() in LISTED else 0.7) + 0.05 * bool(mail) + 0.05 * sign, 2)))
    assert got == sorted(wanted) and got


def question_entities(spark):
    from quarryspark.plans.recognition import ENTITY_STOPWORDS as stop

    got = {}
    for r in sorted(result(spark, "question_entities"), key=lambda r: (r.conv_id, r.turn, r.place)):
        got.setdefault((r.conv_id, r.turn), []).append(r.entity)
    assert got
    letters = "A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű0-9"
    for r in rows(spark, "conversations"):
        if r.role == "user":
            good = lambda ws: all(w.lower() not in stop for w in ws) and len(" ".join(ws)) >= 5
            wanted = [f"{a} {b}" for a, b in regex.findall(rf"\b([{letters}]{{2,}})\s+([{letters}]{{2,}})\b", r.text) if good([a, b])]
            for run in regex.findall(r"\b[A-ZÁÉÍÓÖŐÚÜŰ][\w-]*(?:\s+[A-ZÁÉÍÓÖŐÚÜŰ][\w-]*)*\b", r.text):
                words = regex.findall(rf"[{letters}]{{2,}}", run)
                while words and words[0].lower() in stop:
                    del words[0]
                wanted += [" ".join(words)] if words else []
            low = regex.findall(rf"[{letters}]{{2,}}", r.text.lower())
            wanted += [f"{a} {b}" for a, b in zip(low, low[1:], strict=False) if good([a, b])]
            assert got.get((r.conv_id, r.turn), []) == list(dict.fromkeys(wanted))


def pseudo_embedding(spark):
    for r in result(spark, "pseudo_embedding"):
        assert r.point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, str(r.doc_id))) and r.dim == 64 and len(r.vector_hash) == 64
    text = "a text"
    one, two = hashlib.sha256(text.encode()).digest(), hashlib.sha256(hashlib.sha256(text.encode()).digest()).digest()
    got = spark.createDataFrame([(text,)], "t string").select(folds.hash_embedding("t").alias("v")).first().v
    assert got == pytest.approx([b / 127.5 - 1 for b in one + two], abs=1e-6)


def lead_and_preview(spark):
    got = {r.doc_id: r for r in result(spark, "lead_and_preview")}
    blank = " \t\n\x0b\f\r"
    for d in rows(spark, "documents"):
        bare = d.text.strip(blank)
        m = regex.match(r"(?s)^.*?(?:[.!?](?=[ \t\n\x0b\f\r])|$)", bare)
        flat = regex.sub(f"[{blank}]+", " ", d.text).strip(blank)
        assert got[d.doc_id].lead == m[0][:500]
        assert got[d.doc_id].preview == (flat if len(flat) <= 280 else flat[:280].rstrip(" ") + "…")


def chunk_pack(spark):
    lines = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.trim("line") != "")
    blocks, got = {}, {}
    for r in lines.withColumn("kind", X.block_type(F.col("line"), F.col("i") == 0)).orderBy("doc_id", "i").collect():
        blocks.setdefault(r.doc_id, []).append((r.line, r.kind))
    for r in sorted(result(spark, "chunk_pack"), key=lambda r: (r.doc_id, r.chunk)):
        got.setdefault(r.doc_id, []).append(r.text)
    size = lambda c: sum(len(x) for x, _ in c)
    for d, own in blocks.items():
        chunks = []
        for b in own:
            if not chunks or b[1] in ("title", "heading", "table") or chunks[-1][-1][1] == "table" or size(chunks[-1]) + len(b[0]) > 1800:
                chunks.append([])
            chunks[-1].append(b)
        merged = []
        for chunk in chunks:
            table = merged and "table" in {k for _, k in chunk + merged[-1]}
            if merged and not table and size(chunk) < 200 and size(merged[-1]) + size(chunk) <= 1800:
                merged[-1] = merged[-1] + chunk
            else:
                merged.append(chunk)
        assert got[d] == ["\n".join(x for x, _ in m) for m in merged]


def chunk_overlap_split(spark):
    """Parts of 1,800 characters at most; each begins inside the one before, and nothing between is left out."""
    got = {}
    for r in sorted(result(spark, "chunk_overlap_split"), key=lambda r: (r.doc_id, r.part)):
        got.setdefault(r.doc_id, []).append(r.text)
    for d in rows(spark, "documents"):
        parts = got[d.doc_id]
        assert len(d.text) > 1800 or parts == [d.text]
        end = 0
        for k, part in enumerate(parts):
            assert len(part) <= 1800
            at = d.text.find(part, max(0, end - 201)) if k else d.text.find(part)
            assert at >= 0 and not d.text[end:at].strip() and (not k or at < end)
            end = max(end, at + len(part))
        assert not d.text[end:].strip()


def span_deoverlap(spark):
    got = {}
    for r in result(spark, "span_deoverlap"):
        got.setdefault(r.doc_id, set()).add((r.s, r.e))
    for d in rows(spark, "documents"):
        words = [w for w in regex.findall(r"[\p{L}\p{M}\p{N}_-]+", d.text) if len(w.lower()) >= 2]
        kept, taken = set(), set()
        for n, s in sorted((-len(w.lower()), 3 * i) for i, w in enumerate(words)):
            if taken.isdisjoint(range(s, s - n)):
                taken.update(range(s, s - n))
                kept.add((s, s - n))
        assert got.get(d.doc_id, set()) == kept


def word_layout(spark):
    orders, got = {}, {}
    for r in rows(spark, "lineitem"):
        orders.setdefault(r.l_orderkey, []).append((round(r.l_quantity * 8, 1), r.l_extendedprice, str(r.l_partkey)))
    for r in sorted(result(spark, "word_layout"), key=lambda r: (r.l_orderkey, r.line)):
        got.setdefault(r.l_orderkey, []).append((r.block, r.text))
    for key, words in orders.items():
        lines = []
        for top, _, word in sorted(words):
            if not lines or top - lines[-1][0] > 3:
                lines.append([top, top, []])
            lines[-1][1] = top
            lines[-1][2].append(word)
        block, wanted = 0, []
        for k, (top, _, ws) in enumerate(lines):
            block += k > 0 and top - (lines[k - 1][1] + 10) > 14
            wanted.append((block, " ".join(ws)))
        assert got[key] == wanted


CHECKED = {"dictionary_mentions": lambda spark: dictionary_mentions(spark, DATA)} | {f.__name__: f for f in (sentence_chunks, canonical_payload_hash, nested_redaction, depersonalised_texts, place_mentions, phrase_keywords, company_mentions, recognised_mentions, person_mentions, question_entities, pseudo_embedding, lead_and_preview, chunk_pack, chunk_overlap_split, span_deoverlap, word_layout)}


@pytest.mark.parametrize("name", sorted(CHECKED))
def test_against_brute_force(spark, name):
    CHECKED[name](spark)


def test_temporal_mentions(spark):
    from quarryspark.functions.temporal import temporal_mentions

    text = "On 2024-1-5, 2024. március 3-ig, 2024.01.02 - 2024/02/03. Holnap vagy jövő héten, nem mama. Határidő: péntek reggel! napi, heti"
    got = [tuple(m) for m in spark.createDataFrame([(text,)], "t string").select(temporal_mentions(F.col("t")).alias("m")).first().m]
    assert [m for m in got if m[0] == "date"] == [("date", x, s, None, 0.95) for x, s in (("2024-1-5", "2024-01-05"), ("2024.01.02", "2024-01-02"), ("2024/02/03", "2024-02-03"), ("2024. március 3-ig", "2024-03-03"))]
    assert ("date_range", "2024.01.02 - 2024/02/03", "2024-01-02", "2024-02-03", 0.95) in got
    assert [m[1] for m in got if m[0] == "relative"] == ["Holnap", "jövő héten"] and [m[1] for m in got if m[0] == "recurrence"] == ["napi", "heti"]
    assert [(m[1], m[4]) for m in got if m[0] == "deadline"] == [("Határidő: péntek reggel", 0.8)]


def test_names_and_entities():
    sent = "Best regards, Anna Kovács anna@example.com"
    assert folds.person_names(sent, frozenset(["anna"]), frozenset()) == [("Anna Kovács", 14, 25, 0.8)]
    assert folds.person_names("Kovács Anna", frozenset(["anna"]), frozenset(["anna kovács"])) == [("Anna Kovács", 0, 11, 0.75)]
    assert folds.person_names("Big House", frozenset(["anna"]), frozenset()) == []
    assert folds.entity_candidates("Who is Jane Smith in Budapestről", frozenset(["who", "is", "in"]), ("ről",)) == ["Jane Smith", "Budapestről", "jane smith"]


def test_process_items(spark):
    one = lambda t: [tuple(x) for x in spark.createDataFrame([(t,)], "t string").select(X.process_items(F.col("t")).alias("p")).first().p]
    assert one("1. open it\n- not this\n2. close it") == [("step", 1, "open it", pytest.approx(0.6)), ("step", 2, "close it", pytest.approx(0.6))]
    assert one("- a\n* b\n[ ] c") == [("check", 1, "a", pytest.approx(0.7)), ("check", 2, "b", pytest.approx(0.7)), ("check", 3, "c", pytest.approx(0.7))] and one("nothing") == []
