"""Text derivations as pure Column expressions: they stay inside code generation and can be pushed into scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates the parts of a slug: every run of characters that are neither letters nor digits.
SEPARATORS = r"[^\p{L}\p{N}]+"


def present(*parts: str | Column) -> list[Column]:
    """The parts with blanks turned to nulls, since ``concat_ws`` skips nulls but keeps empty strings."""
    return [F.nullif(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]


def slug(*parts: str | Column, extension: str = ".jpg", separators: str = SEPARATORS) -> Column:
    """File name of a record: lower-cased parts joined by ``_``, any separator run as one ``_``, then the extension.

    Blank and null parts leave no trace; with no part at all the name is the extension alone.
    """
    return F.concat(F.regexp_replace(F.lower(F.concat_ws(" ", *present(*parts))), separators, "_"), F.lit(extension))


def search_text(*parts: str | Column, suffix: str | None = None) -> Column:
    """Query string for a record: the parts that are present, and a fixed suffix, joined by single spaces."""
    return F.concat_ws(" ", *present(*parts), *([F.lit(suffix)] if suffix else []))


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_host(url: str | Column) -> Column:
    """Host of a URL; null when there is none or the URL is malformed."""
    return F.try_parse_url(_column(url), F.lit("HOST"))


def url_path(url: str | Column) -> Column:
    """Path of a URL as it is written, empty for a bare host; null for what is not a URL with a scheme (of any case) and a host, malformed ones too."""
    return F.when(url_host(url).isNotNull() & F.try_parse_url(_column(url), F.lit("PROTOCOL")).isNotNull(), F.try_parse_url(_column(url), F.lit("PATH")))


def url_leaf(url: str | Column) -> Column:
    """Last segment of a URL's path, empty for a directory URL or a bare host; null for what is not a URL."""
    return F.element_at(F.split(url_path(url), "/"), -1)


def url_is_directory(url: str | Column) -> Column:
    """Whether a URL's path ends in ``/`` and so names no file; false for a bare host, null for what is not a URL."""
    return F.endswith(url_path(url), F.lit("/"))


def words(text: str | Column) -> Column:
    """Runs of letters, lower-cased, in order; null for a null."""
    return F.regexp_extract_all(F.lower(_column(text)), F.lit(r"\p{L}+"), F.lit(0))


def url_words(url: str | Column) -> Column:
    """The words of a URL's host and path, in order; null for what is not a URL."""
    return words(F.concat(url_host(url), F.lit("/"), url_path(url)))


def iso_stamp(ts: str | Column) -> Column:
    """ISO-8601 text with milliseconds and a ``Z``; the session time zone should be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
