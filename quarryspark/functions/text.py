"""Text functions: cleaning, classifying, recognising. Columns in, columns out.

Patterns say letters as ``\\p{L}`` and avoid ``\\b``: Java takes both for ASCII only."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that results depend on.
PAGE_NUMBER_LINE = r"(?i)^\s*(?:-\s*)?(?:page\s+)?\d{1,4}(?:\s*[./]\s*\d{1,4})?(?:\s*-)?(?:\s*\.?\s*oldal)?\s*$"
REPEATED_LINE_CHARS, REPEATED_LINE_TIMES = 80, 3
HEADING_CHARS, HEADING_WORDS = 120, 8
WARNING_LINE = r"(?i)^\s*(?:figyelem|figyelmeztetés|fontos|warning|caution|important|attention)\s*[:!]"
NOTE_LINE = r"(?i)^\s*(?:megjegyzés|note|info|tipp|tip)\s*[:!]"
FAQ_LINE = r"(?i)^\s*(?:q|k|kérdés|question)\s*[:.]"
STEP_LINE, LIST_LINE = r"^\s*\d+[.)]\s+\S+", r"^\s*(?:[-*•]|[a-zA-Z]\))\s+\S+"
NUMBERED_HEADING, MARKDOWN_HEADING = r"^\d+(?:\.\d+){0,5}\.?\s+\S+", r"^#{1,6}\s+\S+"
#: Content type detectors: (type, confidence, pattern); words stand between non-letters.
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
CONTENT_TYPES = (
    ("process", 0.86, r"(?m)^\s*\d+\.\s+\S"),
    ("process", 0.74, r"(?iu)" + _B + "(?:kattint|nyissa|kattints|click|open|select)" + _E),
    ("faq", 0.84, r"(?imu)^\s*(?:mi|milyen|hogyan|miért|mikor|what|how|why|when|qué|cómo|por qué)" + _E + r".+\?\s*$"),
    ("policy", 0.8, r"(?iu)" + _B + "(?:kötelező|tilos|szabály|policy|szankció|must not|prohibited)" + _E),
    ("guide", 0.76, r"(?iu)" + _B + "(?:lépésről lépésre|útmutató|guide|how to|tutorial)" + _E),
    ("definition", 0.7, r"(?iu)" + _B + r"(?:jelentése|definíció|definition|az\s+[\p{L}\p{N}_]+\s+egy)" + _E),
    ("reference", 0.68, r"(?iu)" + _B + "(?:lásd|see also|referencia|reference|hivatkozás)" + _E),
    ("note", 0.72, r"(?iu)" + _B + "(?:megjegyzés|note|jegyzet|remark)" + _E),
    ("warning", 0.78, r"(?iu)" + _B + "(?:figyelem|warning|veszély|fontos)" + _E),
)
CHUNK_TYPES, CHUNK_TYPE_CONFIDENCE, DEFAULT_TYPE, DEFAULT_CONFIDENCE = ("table", "list", "step", "warning", "note"), 0.92, "general_text", 0.45
#: The edge of a word, for matches that may begin with another character, and a word's characters.
_EDGE, _CHARS = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))", r"\p{L}\p{N}_"
IDENTIFIERS = {
    "email": _EDGE + rf"[{_CHARS}.+-]+@[{_CHARS}.-]+\.[{_CHARS}]{{2,}}" + _E,
    "phone": _EDGE + r"(?:\+36|06)[\s-]?\d{1,2}[\s-]?\d{3}[\s-]?\d{4}" + _E,
    "url": _B + rf"https?://[{_CHARS}./?=&%-]+",
    "ticket_id": _B + r"[A-Z][A-Z0-9]{1,9}-\d{1,6}" + _E,
    "contract_number": _B + r"(?i)(?:SZERZ|SZ|CTR|K)[-/]?\d{2,4}[-/]\d{1,6}" + _E,
    "invoice_number": _B + r"(?i)(?:SZLA|INV)[-/]?\d{2,4}[-/]?\d{1,8}" + _E,
}
#: Characters of a text that is taken in, at most (fixed value), and what Python calls white space.
INGEST_CHARS = 2_000_000
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def fix_encoding(text: Column) -> Column:
    """Line ends to LF, no-break spaces to blanks; zero-width spaces, byte-order and replacement marks go."""
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\u00a0", " "), ("\u200b", ""), ("\ufeff", ""), ("\ufffd", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_page_numbers(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.rlike(PAGE_NUMBER_LINE))


def repeated_short_lines(lines: Column) -> Column:
    """Short lines that stand at least three times. Counts come from a sorted copy: equal lines are neighbours,
    and the third of a run betrays it."""
    bare = F.array_sort(F.filter(F.transform(lines, strip), lambda x: (x != "") & (F.length(x) <= REPEATED_LINE_CHARS)))
    marked = F.zip_with(bare, F.slice(bare, F.lit(REPEATED_LINE_TIMES), F.greatest(F.size(bare), F.lit(1))), lambda x, y: F.when(x == y, x))
    return F.array_distinct(F.array_compact(marked))


def without_lines(lines: Column, unwanted: Column) -> Column:
    """``unwanted`` should be a plain column: it is looked at for each line."""
    return F.filter(lines, lambda x: ~F.array_contains(unwanted, strip(x)))


def without_consecutive_repeats(lines: Column) -> Column:
    """A line equal to the one before is dropped; blank lines stay. Lines are paired with their predecessors, as
    an expression inside the function would be evaluated anew for each line."""
    before = F.concat(F.array(F.lit(None).cast("string")), lines)
    pairs = F.arrays_zip(lines.alias("x"), before.alias("y"))
    kept = F.filter(pairs, lambda p: p["x"].isNotNull() & ((strip(p["x"]) == "") | p["y"].isNull() | (strip(p["x"]) != strip(p["y"]))))
    return F.transform(kept, lambda p: p["x"])


def collapse_whitespace(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?m) +$", ""), r"\n{3,}", "\n\n"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not anew in each branch."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def block_type(text: Column, first: Column) -> Column:
    """Kind of a block without layout hints: warning, note, faq, table, step, list, title, heading or paragraph."""
    parts = lambda clean: F.struct(F.filter(F.split(clean, "\n"), lambda x: strip(x) != "").alias("lines"), strip(F.substring_index(clean, "\n", 1)).alias("head"))
    return _once(strip(text), lambda clean: F.when(clean == "", "unknown").otherwise(_once(parts(clean), lambda x: _block_type(x["lines"], x["head"], first))))


def _block_type(lines: Column, head: Column, first: Column) -> Column:
    piped = F.size(F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2))
    letters = F.regexp_replace(head, r"[^\p{L}]", "")
    upper = (letters != "") & (letters == F.upper(letters)) & ~letters.rlike(r"[^\p{Lu}]")
    plain = (F.size(F.split(head, r"\s+")) <= HEADING_WORDS) & ~head.rlike("[.!?]")
    heading = (F.size(lines) == 1) & (F.length(head) <= HEADING_CHARS) & (head.rlike(MARKDOWN_HEADING) | (~head.rlike(r"[.;,]$") & (head.rlike(NUMBERED_HEADING) | plain | upper)))
    return (
        F.when(head.rlike(WARNING_LINE), "warning")
        .when(head.rlike(NOTE_LINE), "note")
        .when(head.rlike(FAQ_LINE) | (head.endswith("?") & (F.size(lines) > 1)), "faq")
        .when((F.size(lines) >= 2) & (piped >= F.greatest(F.lit(2), F.size(lines) - 1)), "table")
        .when((F.size(lines) >= 2) & F.forall(lines, lambda x: x.rlike(STEP_LINE)), "step")
        .when(F.forall(lines, lambda x: x.rlike(LIST_LINE)), "list")
        .when(heading, F.when(first, "title").otherwise("heading"))
        .otherwise("paragraph")
    )


def content_type(text: Column, chunk_type: Column | None = None) -> Column:
    """Struct of type and confidence: from the chunk's type, else the surest detector (ties by name), else the default."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), F.struct(F.lit(-s).alias("s"), F.lit(n).alias("n"))) for n, s, p in CONTENT_TYPES]))
    found = _once(F.array_min(hits), lambda best: F.struct(F.coalesce(best["n"], F.lit(DEFAULT_TYPE)).alias("content_type"), F.coalesce(-best["s"], F.lit(DEFAULT_CONFIDENCE)).alias("confidence")))
    if chunk_type is None:
        return found
    known = F.struct(chunk_type.alias("content_type"), F.lit(CHUNK_TYPE_CONFIDENCE).alias("confidence"))
    return F.when(chunk_type.isin(*CHUNK_TYPES), known).otherwise(found)


def identifiers(text: Column, patterns: dict[str, str] = IDENTIFIERS) -> Column:
    """Array of (kind, name) of all identifiers in a text. A plain search for what a kind can't do without goes
    before its pattern."""
    marks = {"email": text.contains("@"), "phone": text.contains("+36") | text.contains("06"), "url": text.contains("://")}
    none = F.array().cast("array<string>")

    def of(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), 0)
        hits = F.when(marks[kind], hits).otherwise(none) if kind in marks else hits
        return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    return F.flatten(F.array(*[of(kind, pattern) for kind, pattern in patterns.items()]))


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits, underscores and hyphens, of two characters at least."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_-]{2,}+"), 0)


def phrases(text: Column) -> Column:
    """Runs of one to three words parted by single white space, leftmost and longest, not overlapping."""
    word = r"[\p{L}\p{M}\p{N}_-]{2,}"
    return F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){word}(?:\s{word}){{0,2}}(?![\p{{L}}\p{{N}}_])"), 0)


def steps(text: Column) -> Column:
    """Array of (order, step) of the numbered lines."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^[^\S\n]*(\d+\.[^\S\n]+.+)$"), 1)
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("long").alias("step_order"), F.trim(F.regexp_replace(x, r"^\d+\.[^\S\n]+", "")).alias("step_text")))


def checklist(text: Column) -> Column:
    """Texts of the lines that begin with a dash, a star or an empty box."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[^\S\n]*(?:[-*]|\[[^\S\n]?\])[^\S\n]+(.+)$"), 1), lambda x: F.trim(x))


def process_items(text: Column) -> Column:
    """Array of (kind, step_order, step_text, confidence): the steps of a text, or its checklist if it has none."""
    found, checks = steps(text), checklist(text)
    row = lambda kind, order, x, n: F.struct(F.lit(kind).alias("kind"), order.cast("long").alias("step_order"), x.alias("step_text"), process_confidence(n).alias("confidence"))
    listed = F.transform(checks, lambda x, i: row("check", i + 1, x, F.size(checks)))
    return F.when(F.size(found) > 0, F.transform(found, lambda s: row("step", s["step_order"], s["step_text"], F.size(found)))).otherwise(listed)


def process_confidence(n: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 + 0.1 * n)


def lead_sentence(text: Column, most: int = 500) -> Column:
    return F.substring(F.regexp_extract(strip(text), r"(?s)^.*?(?:[.!?](?=\s)|$)", 0), 1, most)


def preview(text: Column, most: int = 280) -> Column:
    """The beginning of a text; an ellipsis marks that it goes on."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…")))


def redact(text: Column, most: int = 400) -> Column:
    """E-mail addresses, phone numbers and long numbers are masked, and the text is cut."""
    for pattern, mask in ((r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[email]"), (r"\+\d[\d \-]{7,}\d", "[phone]"), (r"\d{6,}", "[number]")):
        text = F.regexp_replace(text, pattern, mask)
    return F.substring(text, 1, most)


def mask_email(address: Column) -> Column:
    """First character of the name, stars, and the domain."""
    name, domain = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    return F.when(address.contains("@"), F.concat(F.substring(name, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(name) - 1, F.lit(1))), F.lit("@"), domain)).otherwise("***")


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks; the table is made by decomposition, not written down."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


#: Texts that are normalised at once.
NORMALISED = 64


def normal_form(form: str):
    """A vectorised function for a Unicode normal form, which Spark has no built-in for. A batch's texts are strings of Python's by pieces, not
    all at once: a task holds its batch and the result."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        pieces = [texts.slice(at, NORMALISED) for at in range(0, len(texts), NORMALISED)] or [texts]
        done = lambda piece: pa.array([None if x is None else unicodedata.normalize(form, x) for x in piece.to_pylist()], piece.type)
        return pa.concat_arrays([x if pc.all(pc.string_is_ascii(x)).as_py() else done(x) for x in pieces])

    return run


def is_noise(line: Column) -> Column:
    """Lines without a letter, or dotted leaders."""
    return ~line.rlike(r"\p{L}") | line.rlike(r"\.{4,}")


def question_language(text: Column) -> Column:
    """hu by its letters, en by its function words, else hu."""
    return F.when(text.rlike("(?iu)[áéíóöőúüű]"), "hu").when(text.rlike(r"(?i)(?<![\p{L}])(?:the|what|how|is|are|of|and|to|in|for)(?![\p{L}])"), "en").otherwise("hu")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def upload_characters(name: Column, size: Column) -> Column:
    """Characters to expect of an upload, by its extension."""
    kind = F.lower(F.substring_index(name, ".", -1))
    share = F.when(kind == "txt", 1.0).when(kind == "pdf", 0.06).when(kind == "docx", 0.20).otherwise(0.35)
    return F.greatest(F.lit(1), F.bround(size * share, 0).cast("long"))


def extract_strategy(size: Column) -> Column:
    mb = 1024 * 1024
    return F.when(size <= 20 * mb, "memory").when(size <= 200 * mb, "temp_file").when(size <= 1000 * mb, "stream").otherwise("reject")


def close_words(a: Column, b: Column) -> Column:
    """Equal, or one edit apart; nothing is close to an empty word."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.levenshtein(a, b) <= 1)


def origin(url: Column) -> Column:
    """Scheme, host and port of a URL, lower-cased; null if there is none."""
    hit = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+)", 1))
    return F.nullif(hit, F.lit(""))


def ocr_repeats(ocr: Column, text: Column, least: float = 0.9) -> Column:
    """Whether an OCR text says nothing new: contained either way, or nearly all its words are."""
    words = F.array_distinct(F.split(F.lower(ocr), r"\s+"))
    share = F.size(F.array_intersect(words, F.split(F.lower(text), r"\s+"))) / F.greatest(F.size(words), F.lit(1))
    return F.lower(text).contains(F.lower(ocr)) | F.lower(ocr).contains(F.lower(text)) | (share >= least)


#: Cities and regions looked for in texts (fixed values).
CITIES, REGIONS = ("budapest", "debrecen", "szeged", "győr", "pécs"), ("dunántúl", "alföld", "transdanubia")


def _place(raw: Column, kind: str) -> Column:
    return F.struct(raw.alias("raw"), F.lower(raw).alias("place"), F.lit(kind).alias("kind"), F.lit(0.9 if kind == "office" else 0.75).alias("confidence"))


def listed_places(text: Column) -> Column:
    """The cities and regions of ``places`` alone."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(n), _place(F.lit(n), kind)) for kind, names in (("city", CITIES), ("region", REGIONS)) for n in names]))


def places(text: Column) -> Column:
    """Array of (raw, place, kind, confidence): site phrases .9; cities, addresses, rooms and regions .75."""
    word, start = r"[\p{L}\p{N}_]", r"(?<![\p{L}\p{N}_])"
    patterns = {
        "office": rf"(?i){start}{word}+?i\s+(?:irod|telephely|raktár){word}*",
        "address": rf"(?iu){start}\d{{4}}\s[\p{{L}}\p{{N}}_.-]+\s(?:utca|út|tér|körút)\s?\d+\.?",
        "room": rf"(?i){start}(?:tárgyaló|meeting room)\s[\p{{L}}\p{{N}}_-]+",
    }

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: _place(x, kind))

    return F.concat(*[found(k, p) for k, p in patterns.items()], listed_places(text))


def blank_line_blocks(text: Column) -> Column:
    """Blocks between blank lines, trimmed; none is empty."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")


def ingest_normal(text: Column) -> Column:
    """A text as it is taken in, whole: without a byte-order mark at its start (one of them), line ends as LF, composed characters."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\x{FEFF}", "")
    return normal_form("NFC")(F.replace(F.replace(bare, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def ingest_error(normal: Column, most: int = INGEST_CHARS) -> Column:
    """Why a text in its normal form is rejected: it is blank, or has more than ``most`` characters; null if it is taken."""
    return F.when(~normal.rlike(f"[^{WHITE}]"), "TEXT_REQUIRED").when(F.length(normal) > most, "TEXT_TOO_LONG")


def lookup_normal(text: Column) -> Column:
    """A name as it is compared: compatibility characters, lower-cased, white space single and trimmed."""
    return F.btrim(F.regexp_replace(F.lower(normal_form("NFKC")(text)), r"\s+", " "))


def mask_email_for_log(address: Column) -> Column:
    """The log's mask: two characters of the name, and the last five of the domain."""
    name, domain = F.substring_index(address, "@", 1), F.substr(address, F.instr(address, "@") + 1)
    shown = F.when(F.length(domain) < 5, domain).otherwise(F.right(domain, F.lit(5)))
    masked = F.concat(F.left(name, F.lit(2)), F.repeat(F.lit("*"), F.length(name) - 2), F.lit("@"), F.repeat(F.lit("*"), F.length(domain) - F.length(shown)), shown)
    return F.when(address.contains("@") & (F.length(name) >= 4) & (domain != ""), masked).otherwise("[REDACTED]")


def names_address(details: Column, address: str) -> Column:
    """Whether details hold an address in any form that is written: as it is, its hash, either mask."""
    low, given = F.lower(details), F.lit(address.strip().lower())
    forms = (given, F.sha2(given, 256), mask_email(given), mask_email_for_log(given))
    out = F.lit(False)
    for x in forms:
        out = out | F.contains(low, x)
    return out


def json_as(text: Column, path: str, kind: str) -> Column:
    """A value of JSON in the wanted type; null if it is empty or isn't one."""
    return F.nullif(F.get_json_object(text, path), F.lit("")).try_cast(kind)


def extract_error(size: Column, pages: Column, parts: Column, longest: Column, seconds: Column, most_bytes: int = 1000 << 20, most_pages: int = 500, most_parts: int = 50_000, most_chars: int = 50_000, most_seconds: int = 600) -> Column:
    """The first limit of an extraction that is passed; null if none is."""
    return F.when(longest > most_chars, "PART_TOO_LONG").when(size > most_bytes, "TOO_LARGE").when(pages > most_pages, "TOO_MANY_PAGES").when(parts > most_parts, "TOO_MANY_PARTS").when(seconds > most_seconds, "TIMEOUT")


def extract_state(items: Column, failed: Column, timed_out: Column) -> Column:
    return F.when(failed == items, "FAILED").when(timed_out, "PARTIAL_TIMEOUT").when(failed > 0, "PARTIAL").otherwise("COMPLETED")
