"""String functions as column expressions: all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns of the default (Indonesian) rules.
STOP_WORDS = ["dan", "di", "ke", "dari", "yang", "ini", "itu", "ada", "bisa", "sudah", "belum", "tidak", "saat", "pada", "untuk", "dengan", "oleh", "akan", "kami", "saya", "min", "mohon", "tolong"]
CAUSE_AFTER = r"(?i)\b(?:gara-gara|gara2|karena|krn|akibat|sebab)\b"
CAUSE_BEFORE = r"(?i)\b(?:bikin|menyebabkan|mengakibatkan|menimbulkan|memicu)\b"
ESCALATION = r"(?i)\b(?:sampe|sampai|hingga)\b"
LOCATION_HINT = r"(?i)\b(?:jl\.?|jalan|daerah|kelurahan|kecamatan)\s+([a-zA-Z0-9\-]+(?:\s+[a-zA-Z0-9\-]+){0,3})"
SLANG = {"yang": "yg", "sudah": "udh", "tidak": "gak", "dengan": "dg", "banget": "bgt", "tolong": "tlg", "mohon": "mhn", "untuk": "utk", "bisa": "bs", "karena": "krn", "rusak": "rsk", "jalan": "jln", "kemarin": "kmrn", "sekarang": "skrg", "bagaimana": "gmn"}
STRIPPED = r".,!?:;\"'()\[\]{}"
PII = {"national_id": r"\d{16}", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"(?:\+62|62|0)8\d{8,11}"}
SECRET = r"(?i)(password|token|secret|api[_-]?key)\s*[=:]\s*\S+"


def normalized(text: Column) -> Column:
    """Trimmed, lower case, white space collapsed (any Unicode white space)."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def text_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def word_tokens(text: Column) -> Column:
    """Lower-case words; letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1)


def word_count(text: Column) -> Column:
    """Number of ``word_tokens``."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}_]+"))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_\-]+)"), 1)


def pieces(text: Column) -> Column:
    """Words, single other marks and white space runs; together they are the text."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]|\s+)"), 1)


def stop_worded(text: Column, stop: list[str] = STOP_WORDS, least: int = 3) -> Column:
    """Distinct ASCII tokens of at least ``least`` characters that are no stop words."""
    kept = F.filter(F.array_distinct(ascii_tokens(text)), lambda w: F.length(w) >= least)
    return F.array_except(kept, F.array(*map(F.lit, stop)))


def connector_split(text: Column, patterns: list[tuple[str, bool]] | None = None, least: int = 8) -> Column:
    """struct(cause, effect) of the first pattern that leaves two parts of ``least`` characters; else null.

    A pattern's flag says whether the cause stands after the connector.
    """
    patterns = patterns or [(CAUSE_AFTER, True), (CAUSE_BEFORE, False), (ESCALATION, False)]
    tried = []
    for pattern, after in patterns:
        part = F.split(text, pattern, 2)
        left, right = F.trim(part[0]), F.trim(F.get(part, F.lit(1)))
        fits = (F.size(part) == 2) & (F.length(left) >= least) & (F.length(right) >= least)
        cause, effect = (right, left) if after else (left, right)
        tried.append(F.when(fits, F.struct(cause.alias("cause"), effect.alias("effect"))))
    return F.coalesce(*tried)


def location_hints(text: Column, pattern: str = LOCATION_HINT, least: int = 4) -> Column:
    # F.trim itself would be given the place as well, as the characters to trim.
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda h: F.trim(h))
    return F.filter(found, lambda h: F.length(h) >= least)


def stripped_words(text: Column) -> Column:
    """White-space words without marks at either end; empty ones go."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    bare = F.transform(words, lambda w: F.regexp_replace(w, f"^[{STRIPPED}]+|[{STRIPPED}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def _guard(protected: list[str] | Column) -> Column:
    return protected if isinstance(protected, Column) else F.array(*map(F.lit, protected)).cast("array<string>")


def slang(text: Column, words: dict[str, str] = SLANG, protected: list[str] | Column = ()) -> Column:
    """Replace words by their short forms; one closing mark stays."""
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    guard = _guard(protected)

    def one(w: Column) -> Column:
        bare = F.regexp_replace(F.lower(w), r"^[.,!?:;]+|[.,!?:;]+$", "")
        short = F.try_element_at(table, bare)
        tail = F.regexp_extract(w, r"([.,!?])$", 1)
        return F.when(F.array_contains(guard, bare) | short.isNull(), w).otherwise(F.concat(short, tail))

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def typos(text: Column, seed: int | Column, protected: list[str] | Column = ()) -> Column:
    """Swap the middle letters of every seventh word of five letters or more."""
    guard = _guard(protected)

    def one(w: Column, i: Column) -> Column:
        bare = F.regexp_replace(F.lower(w), r"^[.,!?:;]+|[.,!?:;]+$", "")
        p = F.floor(F.length(bare) / 2).cast("int")
        a, b = F.substring(w, p + 1, F.lit(1)), F.substring(w, p + 2, F.lit(1))
        swap = ~F.array_contains(guard, bare) & (F.length(bare) >= 5) & (i % 7 == seed % 7) & a.rlike(r"^\p{L}$") & b.rlike(r"^\p{L}$")
        swapped = F.concat(F.substring(w, F.lit(1), p), b, a, F.substring(w, p + 3, F.length(w)))
        return F.when(swap, swapped).otherwise(w)

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def message_id(tenant: Column, connector: Column, account: Column, source: Column, most: int = 128) -> Column:
    """The four parts joined; beyond ``most`` characters a prefix of up to 63 and the SHA-256 of the whole."""
    whole = F.concat_ws(":", tenant, connector, account, source)
    prefix = F.substring(F.concat_ws(":", tenant, connector, account), 1, 63)
    return F.when(F.length(whole) <= most, whole).otherwise(F.substring(F.concat_ws(":", prefix, F.sha2(whole, 256)), 1, most))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a string column."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def masked_spans(text: Column, spans: Column, least: int = 10) -> Column:
    """``text`` without its spans (start, end; cut from the right), collapsed; the text itself if too little is left."""
    ordered = F.sort_array(spans, asc=False)
    cut = F.aggregate(ordered, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.substring(t, s["end"] + 1, F.length(t))))
    cut = F.trim(F.regexp_replace(cut, r"\s+", " "))
    return F.when(F.length(cut) >= least, cut).otherwise(text)


def salvaged_json(text: Column, array: bool = True) -> Column:
    """The outermost JSON array (or object) within fenced or stray text."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])" if array else r"(?s)(\{.*\})", 1), F.lit(""))


def valid_path(path: Column) -> Column:
    """No empty path, no `.` or `..` segment, not absolute."""
    return (F.length(path) > 0) & ~path.rlike(r"(^|/)\.\.?(/|$)") & ~path.startswith("/")


def scrubbed(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "$1=***")


def has_pii(text: Column) -> Column:
    flags = [text.rlike(p) for p in PII.values()]
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def quoted(word: str) -> str:
    """A pattern that matches ``word`` itself; marks are escaped one by one, which all engines read alike."""
    return re.sub(r"([^\w\s])", r"\\\1", word)


def any_word(text: Column, words: list[str]) -> Column:
    """Whether any of ``words`` is a substring (one pass for all); false for no words."""
    if not words:
        return F.when(text.isNotNull(), False)
    return text.rlike("|".join(map(quoted, words)))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a space.

    Shifted slices are zipped: ``tokens`` may be a long expression, and within a
    lambda it would be evaluated again for every element.
    """
    k = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), k)
    for j in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(j + 1), k), lambda x, y: F.concat_ws(" ", x, y))
    return out


def ngram_hashes(tokens: Column, n: int) -> Column:
    """64-bit keys of the runs of n tokens: token hashes, combined from shifted slices, without the strings."""
    from .vectors import bind

    def combined(h: Column) -> Column:
        k = F.greatest(F.size(h) - (n - 1), F.lit(0))
        out = F.slice(h, F.lit(1), k)
        for j in range(1, n):
            out = F.zip_with(out, F.slice(h, F.lit(j + 1), k), lambda x, y: F.xxhash64(x, y))
        return out

    return bind(F.transform(tokens, lambda w: F.xxhash64(w)), combined)
