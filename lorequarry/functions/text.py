"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

_BLANKS = r"(?U)[\s\x1c-\x1f]+"
_FENCE = "```"


def normalize_text(text: Column) -> Column:
    """Runs of white space (any Unicode kind) as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def content_hash(text: Column) -> Column:
    """SHA-1 of the normalised text."""
    return F.sha1(normalize_text(text))


def stable_chunk_id(source: Column, section: Column, text: Column, occurrence: Column) -> Column:
    """16 hex digits that depend on place, content and occurrence only."""
    nul = F.lit("\0")
    parts = F.concat(source, nul, section, nul, normalize_text(text), nul, occurrence.cast("string"))
    return F.substring(F.sha1(parts), 1, 16)


def derive_chunk_id(stored: Column, source: Column, section: Column, text: Column) -> Column:
    """The stored id, or that of the first occurrence where none is stored."""
    return F.coalesce(F.nullif(stored, F.lit("")), stable_chunk_id(source, section, text, F.lit(0)))


def without_blanks(text: Column) -> Column:
    """All white space (any Unicode kind) removed."""
    return F.regexp_replace(text, _BLANKS, "")


def char_trigrams(text: Column) -> Column:
    """Distinct windows of three characters, white space removed; empty below three characters.

    Works on an array of characters: ``substring`` would scan the text for each window.
    """
    chars = F.filter(F.split(without_blanks(text), ""), lambda c: c != "")

    def windows(c: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(c) - 2),
            lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1), F.element_at(c, i + 2)),
        )

    # the lambda binds the characters, so that they are made once a text
    sets = F.transform(
        F.array(chars),
        lambda c: F.when(F.size(c) >= 3, F.array_distinct(windows(c))).otherwise(F.array().cast("array<string>")),
    )
    return F.element_at(sets, 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))


def slug(title: Column, length: int = 50, drop_number: bool = False) -> Column:
    """File name of a title: letters, digits, underscores and hyphens, blanks as underscores."""
    plain = F.regexp_replace(title, r"^\d+\.\s*", "") if drop_number else title
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(F.trim(plain), r"\s+", "_"), 1, length)


def normalize_bool(value: Column) -> Column:
    """True, false or null from what people write for a yes and a no; numbers by being non-zero."""
    plain = F.lower(F.trim(value.cast("string")))
    number = plain.try_cast("double")
    return (
        F.when(plain.isin("true", "yes", "是"), True)
        .when(plain.isin("false", "no", "否"), False)
        .when(number.isNotNull(), number != 0)
    )


def principal(key: Column) -> Column:
    """Tenant name of an access key: 16 hex digits of its SHA-256."""
    return F.substring(F.sha2(key, 256), 1, 16)


def known_key(key: Column, keys: Iterable[str]) -> Column:
    """Whether a key is one of a list, exactly and by case; digests are compared, so no key stands in a plan."""
    digests = [hashlib.sha256(k.encode()).hexdigest() for k in keys if k]
    return F.coalesce(F.sha2(key, 256).isin(digests), F.lit(False))


def thread_key(key: Column, thread: Column) -> Column:
    """Name of a tenant's conversation in a shared store."""
    return F.concat(principal(key), F.lit(":"), thread)


def valid_thread(thread: Column) -> Column:
    """Whether a thread id has 1 to 48 characters; false for null."""
    return F.coalesce(F.length(thread).between(1, 48), F.lit(False))


def unfence(text: Column) -> Column:
    """What stands between the first two fences of a text that opens with one, without a leading ``json``."""
    bare = F.trim(text)
    inner = F.regexp_replace(F.element_at(F.split(bare, _FENCE), 2), "^json", "")
    return F.when(bare.startswith(_FENCE), F.trim(inner)).otherwise(bare)


def sse_payload(stream: Column) -> Column:
    """Payloads of the ``data: `` lines of an event stream, up to its end marker."""
    lines = F.filter(F.split(stream, "\n"), lambda x: x.startswith("data: "))
    payloads = F.transform(lines, lambda x: F.substring(x, F.lit(7), F.length(x)))
    end = F.array_position(payloads, "[DONE]")
    return F.when(end > 0, F.slice(payloads, F.lit(1), (end - 1).cast("int"))).otherwise(payloads)


def user_message(kind: Column, status: Column) -> Column:
    """Message shown for a failed call, by the kind of error and its status."""
    return (
        F.when(kind == "timeout", "The service took too long, try again later.")
        .when(kind == "connection", "The service cannot be reached.")
        .when((kind == "rate_limit") | (status == 429), "Too many requests, try again later.")
        .when((kind == "auth") | status.isin(401, 403), "Access was denied.")
        .when(status >= 500, "The service failed.")
        .otherwise("The request failed.")
    )
