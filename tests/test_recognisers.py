"""Companies by cases written out by hand, and recognisers as one table function."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quarryspark.functions import recognisers as R
from quarryspark.operators.companies import CompanyFinder, find_companies

FOUND = [
    ("This policy was signed with OpenAI, LLC yesterday.", "en", [("OpenAI, LLC", 28, "with")]),
    ("The team met OpenAI LLC.", "en", [("OpenAI LLC.", 13, None)]),
    ("Az ügyfél a Zalka 2000 Kft. szerződését kéri.", "hu", [("Zalka 2000 Kft.", 12, "a")]),
    ("Contrato con Empresa Ejemplo S.L. firmado.", "es", [("Empresa Ejemplo S.L.", 13, "con")]),
    ("ACME Ltd. sent the invoice.", "en", [("ACME Ltd.", 0, None)]),
    ("We use Series A funding data.", "en", []),
    ("This is a limited offer.", "en", []),
    ("La empresa firmó el contrato.", "es", []),
    ("plain grey boring words gmbh", "de", []),
    ("plain grey boring words GmbH", "de", []),
    ("One Two Three Four Five Ltd", "en", [("Two Three Four Five Ltd", 4, None)]),
    ("Koala Pty Ltd", "en", [("Koala Pty Ltd", 0, None)]),  # the longest form of a place
    ("Koala Ltdx and Koala xLtd", "en", []),
    ("Ltd", "en", []),
    ("the Kft. Alpha", "hu", []),
    ("Alpha Kft.", "en", []),  # a form of another language
    ("Alpha Kft.", None, [("Alpha Kft.", 0, None)]),
    ("Alpha Kft.", "xx", [("Alpha Kft.", 0, None)]),
    ("mid-size 3M Inc", "en", [("mid-size 3M Inc", 0, None)]),
    ("x (Beta) S.A.", "es", [("(Beta) S.A.", 2, None)]),
    ("Pau Sociedad Limitada", "es", [("Pau Sociedad Limitada", 0, None)]),
    ("A" * 41 + " Ltd", "en", []),
    ("", "en", []),
]


@pytest.mark.parametrize(("text", "language", "wanted"), FOUND)
def test_companies_by_hand(text, language, wanted):
    assert [(x.name, x.start, x.stop) for x in CompanyFinder()(text, language)] == wanted


def test_gazetteers():
    finder = CompanyFinder({"en": ["Co", "co"], "global": []}, {"en": ["Company (Co)", "Corporation"]}, known=["acme"])
    assert [(x.name, x.legal_form, x.full_form) for x in finder("the acme Co and acme co and other Co", "en")] == [("acme Co", "Co", "Company (Co)")]
    assert list(CompanyFinder({})("Alpha Ltd", "en")) == []


def test_odd_rows(spark):
    """Nulls, blanks, repeats, extra columns of clashing names, a very long text, an empty table."""
    rows = [(1, None, "en", "x"), (2, "  ", "en", "x"), (3, "Alpha Ltd", None, "x"), (3, "Alpha Ltd", None, "x"), (None, "Beta Inc", "en", "x"), (4, "word " * 300_000 + "Gamma Ltd", "en", "x")]
    docs = spark.createDataFrame(rows, "name int, start string, lang string, suffix string")
    got = find_companies(docs.withColumnRenamed("name", "id"), "id", "start", F.col("lang"))
    assert sorted((r.id or 0, r.name) for r in got.collect()) == [(0, "Beta Inc"), (3, "Alpha Ltd"), (3, "Alpha Ltd"), (4, "Gamma Ltd")]
    assert find_companies(docs.withColumnRenamed("name", "id").limit(0), "id", "start").count() == 0


def test_many_forms_take_linear_time():
    assert sum(1 for _ in CompanyFinder()("Alpha Ltd " * 50_000, "en")) == 50_000


def test_lateral_in_sql_and_as_frames(spark):
    kinds = {"company": R.Companies(), "identifier": R.Identifiers(), "person": R.Persons(["Anna"])}
    R.register(spark, kinds)
    texts = spark.createDataFrame([(1, "Anna Kovács of Alpha Ltd wrote to a.b@c.org", "en"), (2, None, "en"), (3, "nothing", None)], "id int, text string, lang string")
    texts.createOrReplaceTempView("texts_of_mentions")
    by_sql = spark.sql("SELECT id, m.* FROM texts_of_mentions, LATERAL mentions(text, lang, 'company, identifier,person') m")
    by_frame = R.recognised(texts, ["id"], "text", "lang", kinds)
    wanted = {(1, "company", "Alpha Ltd"), (1, "identifier", "a.b@c.org"), (1, "person", "Anna Kovács")}
    assert {(r.id, r.kind, r.name) for r in by_sql.collect()} == {(r.id, r.kind, r.name) for r in by_frame.collect()} == wanted
    text = texts.first().text
    assert all(text[r.start : r.end] == r["name"] for r in by_sql.collect())


@pytest.mark.parametrize("call", ["mentions(text, lang, 'weather')", "mentions(id, lang, 'company')", "mentions(text, lang, lang)", "mentions(text, lang, '')"])
def test_analysis_refuses(spark, call):
    R.register(spark, {"company": R.Companies()})
    spark.createDataFrame([(1, "x", "en")], "id int, text string, lang string").createOrReplaceTempView("one_text")
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT m.* FROM one_text, LATERAL {call} m").collect()


def test_columns_that_clash(spark):
    texts = spark.createDataFrame([("x", "y", "en")], "name string, text string, lang string")
    with pytest.raises(ValueError, match="name"):
        R.recognised(texts, ["name"], "text", "lang", {"company": R.Companies()})


def test_by_document(spark):
    chunks = spark.createDataFrame([(1, 0, "the Alpha Ltd and the Beta Inc"), (1, 1, "the ALPHA Ltd again, the Alpha Ltd"), (2, 0, "the Alpha Ltd")], "doc int, chunk int, text string").withColumn("lang", F.lit("en"))
    found = R.recognised(chunks, ["doc", "chunk"], "text", "lang", {"company": R.Companies()})
    got = {(r.doc, r.normalized): (r.name, r.chunk, r.start, r.n) for r in R.by_document(found, "doc", "chunk").collect()}
    assert got == {(1, "alpha ltd"): ("Alpha Ltd", 0, 4, 3), (1, "beta inc"): ("Beta Inc", 0, 22, 1), (2, "alpha ltd"): ("Alpha Ltd", 0, 4, 1)}
