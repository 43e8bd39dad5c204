"""Text: search terms, snippets, paragraphs, type-id patterns, aliases, media types and cell guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_term(text: Column) -> Column:
    """Control characters out, white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"\s+", " "))


def like_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def snippet(text: Column, term: Column, radius: int = 60) -> Column:
    """The first hit with up to ``radius`` characters on both sides, an ellipsis where text was cut; the start of the
    text where the term does not occur."""
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(at - radius, F.lit(1))
    stop = F.least(at + F.char_length(term) + radius - 1, F.char_length(text))
    hit = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, stop - start + 1), F.when(stop < F.char_length(text), "…").otherwise(""))
    none = F.concat(F.substring(text, 1, 2 * radius), F.when(F.char_length(text) > 2 * radius, "…").otherwise(""))
    return F.when(at > 0, hit).otherwise(none)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def type_matches(type_id: Column, pattern: str) -> Column:
    """``*`` fits all, ``x*`` ids that start with x, anything else itself."""
    if pattern == "*":
        return F.lit(True)
    return F.startswith(type_id, F.lit(pattern[:-1])) if pattern.endswith("*") else type_id == pattern


def alias(host: Column) -> Column:
    """A host name in lower case without port, trailing dot and leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r":\d+$", ""), r"(^www\.)|(\.$)", "")


def common_suffix(hosts: Column) -> Column:
    """The longest run of trailing labels that all hosts share; empty without one of at least two labels."""
    parts = F.transform(hosts, lambda h: F.reverse(F.split(h, r"\.")))
    first = F.element_at(parts, 1)
    n = F.size(F.filter(F.sequence(F.lit(1), F.size(first)), lambda i: F.forall(parts, lambda p: F.slice(p, 1, i) == F.slice(first, 1, i))))
    return F.when(n >= 2, F.array_join(F.reverse(F.slice(first, 1, n)), ".")).otherwise("")


#: Media types by file ending.
MEDIA = {
    "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
}


def media_by_name(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def media_by_content(data: Column) -> Column:
    """By the first bytes; null where they say nothing."""
    starts = lambda x: F.startswith(F.hex(F.substring(data, 1, 12)), F.lit(x.hex().upper()))
    return (
        F.when(starts(b"%PDF-"), "application/pdf").when(starts(b"\x89PNG\r\n\x1a\n"), "image/png").when(starts(b"\xff\xd8\xff"), "image/jpeg")
        .when(starts(b"GIF8"), "image/gif").when(starts(b"RIFF") & (F.hex(F.substring(data, 9, 4)) == b"WEBP".hex().upper()), "image/webp").when(starts(b"PK\x03\x04"), "application/zip")
    )


def truncate_name(name: Column, limit: int) -> Column:
    """A file name cut to ``limit`` characters, its ending kept."""
    end = F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,10})$", 1)
    return F.when(F.char_length(name) <= limit, name).otherwise(F.concat(F.substring(name, F.lit(1), F.lit(limit) - F.char_length(end)), end))


def safe_cell(text: Column) -> Column:
    """A spreadsheet cell: a value that a spreadsheet could take for a formula gets a leading apostrophe."""
    return F.when(F.regexp_like(text, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), text)).otherwise(text)


def backoff(attempt: Column, base_ms: int, cap_ms: int) -> Column:
    """base * 2 ** (attempt - 1), at most the cap."""
    return F.least(F.lit(base_ms).cast("double") * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(float(cap_ms))).cast("bigint")


def data_uri(media: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))
