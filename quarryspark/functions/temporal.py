"""Dates in texts: numeric and Hungarian dates, ranges, relative dates, deadlines, recurrences. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, relative and recurrence words, deadline words, confidences.
MONTHS = ("január", "február", "március", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "december")
RELATIVE = ("ma", "holnap", "tegnap", "jövő héten", "múlt héten")
DEADLINE = ("határidő", "deadline")
RECURRENCE = ("napi", "heti", "havi", "éves", "ismétlődő")
DATED, DUE, OTHER = 0.95, 0.8, 0.6

_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_DAY = r"(\d{4})[./-]\s?(\d{1,2})[./-]\s?(\d{1,2})"
_TIGHT = r"(\d{4})[./-](\d{1,2})[./-](\d{1,2})"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def _iso(x: Column, pattern: str, first: int = 1) -> Column:
    part = lambda k: F.regexp_extract(x, pattern, first + k)
    return F.concat_ws("-", part(0), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))


def temporal_mentions(text: Column) -> Column:
    """Array of (temporal_type, raw, start, end, confidence) in the order of the kinds; a kind whose mark the text
    hasn't got isn't looked for."""

    def found(kind: str, pattern: str, start, end=None, confidence: float = OTHER, mark: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        row = lambda x: F.struct(F.lit(kind).alias("temporal_type"), F.trim(x).alias("raw"), (start(x) if start else none).alias("start"), (end(x) if end else none).alias("end"), F.lit(confidence).alias("confidence"))
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), row)
        return hits if mark is None else F.when(mark, hits).otherwise(F.array().cast("array<struct<temporal_type:string,raw:string,start:string,end:string,confidence:double>>"))

    digits = text.rlike(r"\d{4}")
    month = lambda x: F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(x, rf"(?iu)({_any(MONTHS)})", 1))).cast("string"), 2, "0")
    hungarian = lambda x: F.concat_ws("-", F.substring(x, 1, 4), month(x), F.lpad(F.regexp_extract(x, rf"(?iu){_any(MONTHS)}\s?(\d{{1,2}})", 1), 2, "0"))
    low = F.lower(text)
    has = lambda words: low.rlike(_any(words))
    return F.concat(
        found("date", rf"{_B}{_DAY}{_E}", lambda x: _iso(x, _DAY), confidence=DATED, mark=digits),
        found("date", rf"(?iu){_B}\d{{4}}\.\s?{_any(MONTHS)}\s?\d{{1,2}}(?:-(?:t[őó]l|ig))?{_E}", hungarian, confidence=DATED, mark=digits),
        found("date_range", rf"{_B}{_TIGHT}\s*[-–]\s*{_TIGHT}{_E}", lambda x: _iso(x, _TIGHT), lambda x: _iso(x, rf"[-–]\s*{_TIGHT}$"), DATED, digits),
        found("relative", rf"(?iu){_B}{_any(RELATIVE)}{_E}", None, mark=has(RELATIVE)),
        found("deadline", rf"(?iu){_B}{_any(DEADLINE)}\s*:?\s*[^.!\n]+", None, confidence=DUE, mark=has(DEADLINE)),
        found("recurrence", rf"(?iu){_B}{_any(RECURRENCE)}{_E}", None, mark=has(RECURRENCE)),
    )
