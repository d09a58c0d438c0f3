"""Scalar column functions over subjects, paths, blocks and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a text
# (Unicode White_Space plus the four information separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same as a Java regex class body, used under the (?U) flag.
SPACE_CLASS = r"\s\x1c-\x1f"

# Fixed value: namespace of the point ids.
POINT_NAMESPACE = "6f1e7c4a-0000-4000-8000-000000000001"

SNIPPET_CHARS = 400
MIN_K, MAX_K = 1, 50


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def subject_tag(subject: Column) -> Column:
    """Upper-case tag in brackets at the start of a subject, else NULL."""
    return null_if_empty(F.regexp_extract(subject, rf"(?U)^[{SPACE_CLASS}]*\[([A-Z0-9_]+)\]", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    base = base_name(path)
    return F.when(F.contains(base, F.lit(".")), F.lower(F.substring_index(base, ".", -1))).otherwise("")


def module_of(path: Column, module_root: str, core_root: str, core_module: str) -> Column:
    """Module a path belongs to: below the module root, the core, or the first segment."""
    below_root = F.substr(path, F.lit(len(module_root) + 1))
    return (
        F.when(path.startswith(module_root), F.substring_index(below_root, "/", 1))
        .when(path.startswith(core_root), F.lit(core_module))
        .otherwise(F.substring_index(path, "/", 1))
    )


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def parse_iso_time(text: Column) -> Column:
    return F.try_to_timestamp(null_if_empty(text))


def format_iso_time(ts: Column) -> Column:
    """ISO 8601 with offset; the fraction only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    precise = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.date_trunc("second", ts) == ts, whole).otherwise(precise)


def format_day(ts: Column) -> Column:
    """Date only; `?` when missing."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("?"))


def looks_like_identifier(query: Column) -> Column:
    """A bare code token: no blanks, and an underscore, a dot or a camel hump."""
    q = strip(query)
    return q.rlike(r"^[A-Za-z0-9_.]+\z") & (
        F.contains(q, F.lit("_")) | F.contains(q, F.lit(".")) | q.rlike("[a-z][A-Z]")
    )


def snippet(diff_text: Column) -> Column:
    return null_if_empty(strip(F.left(F.coalesce(diff_text, F.lit("")), F.lit(SNIPPET_CHARS))))


def commit_link(sha: Column, source: Column, repo_by_source: dict[str, str], default_repo: str, base: str) -> Column:
    repo = F.lit(default_repo)
    for name, value in repo_by_source.items():
        repo = F.when(source == name, F.lit(value)).otherwise(repo)
    return F.concat(F.lit(base + "/"), repo, F.lit("/commit/"), sha)


def truncate_diff(diff_text: Column, max_chars: int) -> tuple[Column, Column]:
    """(text cut with a marker, truncated flag)."""
    if max_chars < 0:
        raise ValueError("max_chars must not be negative")
    diff = F.coalesce(diff_text, F.lit(""))
    too_long = F.length(diff) > max_chars
    cut = F.concat(F.substring(diff, 1, max_chars), F.lit(f"\n... [truncated at {max_chars} chars]"))
    return F.when(too_long, cut).otherwise(diff), too_long


def clamp_k(k: Column) -> Column:
    return F.greatest(F.lit(MIN_K), F.least(k, F.lit(MAX_K)))


def point_id(sha: Column) -> Column:
    """Version 5 UUID of the sha in the fixed namespace."""
    ns = F.unhex(F.lit(POINT_NAMESPACE.replace("-", "")))
    h = F.sha1(F.concat(ns, F.encode(sha, "UTF-8")))
    # The variant digit keeps its low two bits below the fixed high bits 10.
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def is_hex_id(sha: Column) -> Column:
    return sha.rlike(r"^[0-9a-fA-F]+\z")


def lexemes(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    return lexemes_of_lowered(F.lower(F.coalesce(text, F.lit(""))))


def lexemes_of_lowered(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_text(subject: Column, body: Column, diff_text: Column) -> Column:
    """What full-text search indexes: subject, body and diff, not the document text."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (subject, body, diff_text)])
