"""Reading questions: time hints, intent, retrieval mode, hint terms, limits; and small state ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal words of the intents in order of precedence, and language codes of OCR hints.
INTENTS = (
    ("timeline", ("időrend", "timeline", "mikor", "meddig", "mettől", "előtte", "utána")),
    ("relation", ("kapcsolat", "viszony", "kapcsolódik", "kapcsolódnak", "köze van")),
    ("attribute", ("milyen", "mennyi", "mekkora", "státusz", "állapot", "attribútum")),
    ("activity", ("mit csinál", "mit csinált", "mi történt", "ki dolgozik", "ki vezet")),
)
OCR_LANGUAGES = {"hun": "hu", "hu": "hu", "eng": "en", "en": "en", "spa": "es", "es": "es"}
PERIOD_RANKS = {"monthly": 1, "quarterly": 2, "yearly": 3}


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def time_window(question: Column) -> Column:
    """Struct of the first and last second of the day, month or year that a question names, the most exact first."""
    day = F.nullif(F.regexp_extract(question, r"(?<!\d)((?:19|20)\d{2}-\d{2}-\d{2})(?!\d)", 1), F.lit(""))
    month = F.nullif(F.regexp_extract(question, r"(?<!\d)((?:19|20)\d{2}-\d{2})(?!\d)", 1), F.lit(""))
    year = F.nullif(F.regexp_extract(question, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit(""))
    first = F.coalesce(day.try_cast("date"), F.concat(month, F.lit("-01")).try_cast("date"), F.concat(year, F.lit("-01-01")).try_cast("date"))
    after = F.when(day.isNotNull(), F.date_add(first, 1)).when(month.isNotNull(), F.add_months(first, 1)).otherwise(F.add_months(first, 12))
    return F.struct(first.cast("timestamp_ntz").alias("from"), (after.cast("timestamp_ntz") - F.expr("interval 1 second")).alias("to"))


def intent(question: Column) -> Column:
    low, out = F.lower(question), None
    for name, words in INTENTS:
        out = F.when(contains_any(low, words), name) if out is None else out.when(contains_any(low, words), name)
    return out.otherwise("summary")


def retrieval_mode(wanted: Column, entity_heavy: Column) -> Column:
    return F.when(wanted == "timeline", "timeline_first").when(wanted.isin("relation", "attribute") | entity_heavy, "entity_first").otherwise("assertion_first")


def hint_terms(question: Column, stopwords: tuple[str, ...], most: int = 8) -> Column:
    """The first words of four letters or more that aren't stop words, in order, each once."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_-]+"), 0)
    return F.array_distinct(F.slice(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*stopwords)), 1, most))


def language_hints(raw: Column) -> Column:
    """Codes such as "hun+eng" as language codes, unknown ones dropped, each once."""
    table = F.create_map(*[F.lit(x) for pair in OCR_LANGUAGES.items() for x in pair])
    return F.array_distinct(F.array_compact(F.transform(F.split(raw, r"\+"), lambda x: F.element_at(table, F.lower(F.trim(x))))))


def rebuild_status(items: Column, failed: Column, reindexed: Column, verified: Column, delete_failed: Column) -> Column:
    nothing = (reindexed <= 0) | ((items > 0) & (failed >= items))
    return F.when(nothing, "failed").when((failed > 0) | delete_failed | (verified < reindexed), "partial").when(verified == reindexed, "completed").otherwise("partial")


def period_rank(period: Column) -> Column:
    out = None
    for name, rank in PERIOD_RANKS.items():
        out = F.when(F.lower(F.trim(period)) == name, rank) if out is None else out.when(F.lower(F.trim(period)) == name, rank)
    return out.otherwise(1)


def scheduled_change(price: Column, next_price: Column, period: Column, next_period: Column, same_plan: Column) -> Column:
    """A cheaper plan, or a shorter period of the same plan, begins with the next period."""
    return (next_price < price) | (same_plan & (period_rank(next_period) < period_rank(period)))


def dominant_type(kinds: Column, mapped: tuple[str, ...], default: str = "text") -> Column:
    """The most frequent special kind (the first of equals in ``mapped``), if there are no more plain ones."""
    count = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    best = F.array_max(F.array(*[F.struct(count(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(mapped)]))
    plain = F.size(F.filter(kinds, lambda x: ~x.isin(*mapped)))
    return F.when((best["n"] > 0) & (best["n"] >= plain), best["k"]).otherwise(default)


def section_hash(item: Column, path: Column, title: Column, parts: Column) -> Column:
    """Hash of where a chunk belongs: item, heading path, title and source parts, in a fixed order."""
    return F.sha2(F.to_json(F.struct(item.alias("item"), path.alias("path"), title.alias("title"), F.array_sort(parts).alias("parts"))), 256)


def merged_json(old: Column, patch: Column) -> Column:
    """Flat JSON objects merged, the patch winning; what isn't an object counts as empty."""
    kind = "map<string,string>"
    empty = F.create_map().cast(kind)
    a, b = (F.coalesce(F.from_json(x, kind), empty) for x in (old, patch))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def point_payload(chunk: Column, base: Column, language: Column, source: Column, preview_chars: Column) -> Column:
    """What an index stores beside a vector, as JSON in a fixed order."""
    return F.to_json(F.struct(chunk.alias("chunk_id"), base.alias("knowledge_base_id"), F.coalesce(language, F.lit("unknown")).alias("language"), F.coalesce(source, F.lit("none")).alias("source"), F.lit("active").alias("status"), preview_chars.alias("preview_chars")))
