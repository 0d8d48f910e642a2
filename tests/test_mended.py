"""Small cases written out by hand, for branches that the given tables don't reach."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarryspark.functions import folds
from quarryspark.functions import text as X
from quarryspark.operators import issues as I
from quarryspark.operators import knowledge as K
from quarryspark.plans import control


def test_ingest(spark):
    cases = [
        ("﻿a\r\nb\rc", "a\nb\nc", None),
        ("﻿﻿a﻿", "﻿a﻿", None),  # one mark at the start only
        ("é", "é", None),
        (None, "", "TEXT_REQUIRED"),
        ("", "", "TEXT_REQUIRED"),
        (" \t\r\n 　\x1c", None, "TEXT_REQUIRED"),
        ("x" * 50, "x" * 50, None),
        ("x" * 51, "x" * 51, "TEXT_TOO_LONG"),
        ("é" * 50, "é" * 50, None),  # fifty once composed
        ("​", "​", None),  # not white space
    ]
    rows = spark.createDataFrame([(k, x) for k, (x, _, _) in enumerate(cases)], "k int, text string")
    found = {r.k: r for r in rows.select("k", X.ingest_normal(F.col("text")).alias("n")).withColumn("e", X.ingest_error(F.col("n"), 50)).collect()}
    for k, (x, normal, error) in enumerate(cases):
        wanted = unicodedata.normalize("NFC", (x or "").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n"))
        assert found[k].n == wanted and found[k].e == error
        assert normal is None or wanted == normal
    assert X.INGEST_CHARS == 2_000_000


def test_long_sentences_are_sliced():
    short, long = "A short sentence is here.", "w" * 2000 + "."
    assert folds.pack_sentences(f"{short} {long} {short}") == [short, "w" * 900, "w" * 900, "w" * 200 + ".", short]
    assert folds.pack_sentences("x" * 900) == ["x" * 900]
    assert folds.pack_sentences(f"{'y' * 899}. {short}") == ["y" * 899 + ".", short]
    assert folds.pack_sentences("z" * 910) == ["z" * 900]  # the rest of ten characters is too short
    assert all(len(x) <= 900 for x in folds.pack_sentences("ab. " * 5 + "v" * 5000 + " tail of it. " * 200))


IDENTIFIERS = [
    ("hívd 06 30 123 4567 most", [("phone", "06 30 123 4567")]),
    ("4406301234567", []),  # inside a longer number
    ("06301234567890", []),
    ("szám:x+36301234567", [("phone", "+36301234567")]),
    ("xABC-12 and ABC-12x and ABC-1234567", []),
    ("(ABC-12)", [("ticket_id", "ABC-12")]),
    ("éABC-12", []),
    ("aSZ-2024/12", []),
    ("sz-2024/12.", [("contract_number", "sz-2024/12")]),
    ("INV-2024-17", [("invoice_number", "INV-2024-17"), ("ticket_id", "INV-2024")]),
    ("preINV-2024-17", []),
    ("mail josé.ű@példa.hu!", [("email", "josé.ű@példa.hu")]),
    ("seehttps://a.b xhttp://", []),
    ("see https://a.b/é?q=1 now", [("url", "https://a.b/é?q=1")]),
]


def test_identifiers_at_word_edges(spark):
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(IDENTIFIERS)], "k int, text string")
    found = {r.k: sorted((x.kind, x.name) for x in r.x) for r in rows.select("k", X.identifiers(F.col("text")).alias("x")).collect()}
    assert [found[k] for k in range(len(IDENTIFIERS))] == [sorted(w) for _, w in IDENTIFIERS]


def replay(events):
    """One event after the other, as the service does it."""
    issues = {}
    for e in sorted(events, key=lambda e: (e["ts"], e["order"])):
        key = (e["item"], e["code"])
        now = issues.get(key)
        meta = json.loads(e["metadata"]) if e["metadata"] and e["metadata"].startswith("{") else {}
        if e["status"] is not None:
            if now:
                now["status"], now["resolved_at"] = e["status"], e["ts"] if e["status"] in I.TERMINAL else None
        elif now is None:
            issues[key] = {"first_seen_at": e["ts"], "last_seen_at": e["ts"], "occurrence_count": 1, "status": "OPEN", "resolved_at": None, "severity": e["severity"], "message": (e["message"] or "")[:4000] or None, "job_id": e["job_id"] or None, "step": e["step"] or None, "metadata": meta}
        else:
            now["occurrence_count"] += 1
            now["last_seen_at"], now["severity"] = e["ts"], e["severity"]
            for c in ("message", "job_id", "step"):
                if e[c]:
                    now[c] = e[c][:4000]
            now["metadata"] = {**now["metadata"], **meta}
            if now["status"] in I.TERMINAL:
                now["status"], now["resolved_at"] = "OPEN", None
    return issues


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_issues_equal_a_replay(spark, seed):
    """Three batches into a stored table: reopening, changes before the first occurrence, nested metadata, null keys."""
    r = random.Random(seed)
    shape = "item string, code string, ts long, order long, status string, severity string, message string, job_id string, step string, metadata string"
    nested = lambda: json.dumps({r.choice("abc"): r.choice([1, "x", None, [1, {"y": 2.5}], {"deep": {"er": [True]}}]) for _ in range(r.randrange(3))})
    events = [
        {"item": r.choice([None, "i1", "i2", "i3", f"i{k}"]), "code": r.choice("PQ"), "ts": k // 2, "order": k, "status": r.choice([None, None, "RESOLVED", "IGNORED", "ACKNOWLEDGED"]), "severity": r.choice(["low", "high"]), "message": r.choice([None, "", "m" * 5000, f"m{k}"]), "job_id": r.choice([None, "", f"j{k}"]), "step": r.choice([None, f"s{k}"]), "metadata": r.choice([None, "", "[1]", "{}", nested(), nested()])}
        for k in range(240)
    ]
    stored = None
    for batch in (events[:100], events[100:110], events[110:]):
        frame = spark.createDataFrame([tuple(e.values()) for e in batch], shape).repartition(3)
        rows = I.upsert_issues(stored, frame, ["item", "code"]).collect()
        stored = spark.createDataFrame([tuple(x) for x in rows], "item string, code string, first_seen_at long, last_seen_at long, occurrence_count long, status string, resolved_at long, severity string, message string, job_id string, step string, metadata string")
    wanted, found = replay(events), {(x.item, x.code): x for x in rows}
    assert set(found) == set(wanted)
    for key, want in wanted.items():
        got = found[key].asDict()
        assert json.loads(got["metadata"] or "{}") == want["metadata"]
        assert {c: got[c] for c in want if c != "metadata"} == {c: v for c, v in want.items() if c != "metadata"}


def test_alert_rules(spark):
    """At, below and above each threshold; the error rate needs 100 requests, the login outage no login."""
    quiet = dict.fromkeys(["requests", "db_errors", "failed_logins", "no_logins", "most_by_ip", "most_by_mail", "new_ips", "escalations", "denied", "limited", "bad_tokens", "error_share", "queue_failures", "new_devices", "deployments", "new_admins", "exports"], 0.0)

    def triggered(**measures):
        row = spark.createDataFrame([tuple({**quiet, **measures}.values())], ", ".join(f"{k} double" for k in quiet))
        return {r.rule for r in K.rule_rows([row], control._RULES).where("status = 'triggered'").collect()}

    assert triggered() == {"p1_api_not_responding"}
    assert triggered(requests=1.0, denied=14.0, queue_failures=4.0, new_devices=9.0) == set()
    assert triggered(requests=1.0, denied=15.0, queue_failures=5.0) == {"p1_permission_denied_spike", "p2_queue_failure_rise"}
    assert triggered(requests=99.0, error_share=50.0) == set()
    assert triggered(requests=100.0, error_share=2.0) == set()
    assert triggered(requests=100.0, error_share=2.01) == {"p2_error_rate"}
    assert triggered(requests=5.0, failed_logins=20.0) == set()
    assert triggered(requests=5.0, failed_logins=20.0, no_logins=1.0) == {"p1_login_outage"}
    assert triggered(requests=1000.0, exports=1.0, new_ips=1.0) == {"p3_usage_spike", "p3_export_completed", "p1_admin_login_new_country_ip"}
    assert len(control._RULES) == 24


COUNTED = [
    "tel. 0621567258911 and 063020011223344",  # longer runs of digits
    "a.b@c.de+x@y.zz, a+b@c.d-e.fg_ and x@y, é.x@q.hu_ a@b.c@d.ef",
    "xhttp://a.b/c ABC-1234567 xAB-12y 1AB-3",
    "\u017fz-12/3 \u212a-12-3 k12/3x ctr/2024/17 xSZERZ-1234-1",
    "inv2024 \u0131nv2024 SZLA/12/123456789 \u017fzla12",
    "+36\x0b30 200 1122 +36 30 200 1122 06-1-234 5678",
    "",
]


def test_counted_identifiers_equal_the_sql(spark, duck):
    """Counts of identifiers follow the patterns of their SQL, which have no edges of words."""
    from quarryspark.plans.recognition import _IDENTIFIERS, _IDS

    rows = spark.createDataFrame(list(enumerate(COUNTED)), "k int, text string")
    found = {r.k: [x.name for x in r.x] for r in rows.select("k", X.identifiers(F.col("text"), _IDENTIFIERS).alias("x")).collect()}
    for k, text in enumerate(COUNTED):
        wanted = duck.execute("SELECT " + ", ".join(f"regexp_extract_all($1, '{p}')" for p in _IDS), [text]).fetchall()[0]
        assert found[k] == [x for xs in wanted for x in xs], text


@pytest.mark.parametrize("name", ["chunk_recognition_counts", "recognised_knowledge_score"])
def test_recognition_counts_on_more_texts(spark, duck, name):
    """Texts of sf0.01, where identifiers stand inside longer words."""
    import duckdb
    from support import same_rows

    from quarryspark.plans import QUERIES, SQL

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    same_rows(QUERIES[name](spark, folder), con.sql(SQL[name]))


def test_normal_forms_stay_in_arrow(spark):
    """Equal to Python's over pieces of batches, nulls and empty texts among them; no pandas, which makes strings of whole batches."""
    texts = [None, "", "plain", "é", "ạ̇", "각", "ﬁ ①", *["x" * k + "ő" for k in range(300)], *[None] * 70]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    for form in ("NFC", "NFKC"):
        plan = rows.select("k", X.normal_form(form)(F.col("text")).alias("n"))
        assert {r.k: r.n for r in plan.collect()} == {k: None if x is None else unicodedata.normalize(form, x) for k, x in enumerate(texts)}
    assert not hasattr(X, "pd")


def test_tokens_and_listed_places_without_functions_of_elements(spark):
    """Tokens come from one search of the lower-cased text, and listed places don't need the patterns of the others."""
    texts = ["A bc D-e _F ÁRVÍZ 12 3", "İ x", "Budapest és Dunántúl, budai iroda", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = rows.select("k", X.tokens(F.col("text")).alias("t"), X.listed_places(F.col("text")).alias("p"), X.places(F.col("text")).alias("all")).orderBy("k").collect()
    assert [r.t for r in got] == [["bc", "d-e", "_f", "árvíz", "12"], ["i̇"], ["budapest", "és", "dunántúl", "budai", "iroda"], [], None]
    assert [[p.place for p in r.p] for r in got] == [[], [], ["budapest", "dunántúl"], [], []]
    assert [p.kind for p in got[2]["all"]] == ["office", "city", "region"]
    assert "lambda" not in rows.select(X.tokens(F.col("text")))._jdf.queryExecution().analyzed().toString().lower()
