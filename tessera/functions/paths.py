"""Path functions as column expressions: no Python runs per row."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidPath

SEGMENT_BYTES = 255
RESERVED = (".abstract", ".overview")
#: Not allowed in a segment: NUL, colon, controls, bidi marks and the line and paragraph separators.
FORBIDDEN = r"[\x00-\x1F\x7F-\x9F:\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{2028}\x{2029}]"


def normalize(path: Column) -> Column:
    """``/``-rooted path without empty, ``.`` and ``..`` segments; null where it is not a valid path.

    Empty means the root. A path without a leading slash, one that leaves the root, and one with a
    forbidden or overlong segment are null; ``require_path`` raises for literals.
    """
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    # an array of kept segments, or null once a ".." has left the root
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s != "..", F.concat(kept, F.array(s))).when(F.size(kept) > 0, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))),
    )
    bad = F.exists(folded, lambda s: (F.octet_length(s) > SEGMENT_BYTES) | F.regexp_like(s, F.lit(FORBIDDEN)))
    valid = folded.isNotNull() & ~bad & (path.startswith("/"))
    return F.when(path == "", F.lit("/")).when(valid, F.concat(F.lit("/"), F.array_join(folded, "/")))


def normalize_lenient(path: Column) -> Column:
    return normalize(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def require_path(path: str, lenient: bool = False) -> str:
    """The normal form of a literal path; raises ``InvalidPath``."""
    path = unicodedata.normalize("NFC", path)
    if lenient and not path.startswith("/"):
        path = "/" + path
    if not path:
        return "/"
    if not path.startswith("/"):
        raise InvalidPath("path must start with /")
    kept: list[str] = []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if not kept:
                raise InvalidPath("path leaves the root")
            kept.pop()
        elif len(part.encode()) > SEGMENT_BYTES or re.search(FORBIDDEN.replace(r"\x{", r"\u").replace("}", ""), part):
            raise InvalidPath(f"segment not allowed: {part[:40]!r}")
        else:
            kept.append(part)
    return "/" + "/".join(kept)


def parent(path: Column) -> Column:
    """The directory of a normal path; the root is its own."""
    up = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(up == "", F.lit("/")).otherwise(up)


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return F.when(path == "/", F.lit(0)).otherwise(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))


def ancestors(path: Column) -> Column:
    """All proper ancestors of a normal path, root first."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit("/")), up)).when(F.size(parts) == 1, F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))


def under(path: Column, prefix: Column | str) -> Column:
    """Whether ``path`` is ``prefix`` or below it; siblings that share the prefix's letters are not."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (prefix == "/") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def strictly_under(path: Column, prefix: str) -> Column:
    return path.startswith("/" if prefix == "/" else prefix + "/") & (path != "/")


def rebased(path: Column, old: str, new: str) -> Column:
    """``path`` with its leading ``old`` replaced, by characters."""
    return F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))


def same_path(a: Column, b: Column) -> Column:
    """Case- and accent-insensitive equality, as lookups compare paths; filters stay byte-exact."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: ``*`` stays in a segment, ``**`` crosses (and takes a slash
    that follows), ``?`` is one character of a segment."""
    out, at = "", 0
    while at < len(pattern):
        if pattern.startswith("**", at):
            at += 2
            if pattern.startswith("/", at):
                at += 1
            out += ".*"
        elif pattern[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif pattern[at] == "?":
            out, at = out + "[^/]", at + 1
        else:
            out, at = out + re.escape(pattern[at]), at + 1
    return f"(?s)^{out}$"


def glob(path: Column, pattern: str) -> Column:
    """Whether ``path`` fits ``pattern``; the fixed prefix is tested apart, for scans to push down."""
    prefix = glob_prefix(pattern)
    fits = F.regexp_like(path, F.lit(glob_regex(pattern)))
    return fits if prefix == "/" else path.startswith(prefix) & fits


def glob_prefix(pattern: str) -> str:
    """The leading segments without wildcards."""
    kept = []
    for part in pattern.split("/"):
        if "*" in part or "?" in part:
            break
        kept.append(part)
    return "/".join(kept) or "/"


def glob_prefix_of(pattern: Column) -> Column:
    """``glob_prefix`` as an expression."""
    whole = ~F.regexp_like(pattern, F.lit(r"[*?]"))
    fixed = F.when(whole, pattern).otherwise(F.regexp_extract(pattern, r"^((?:[^/*?]*/)*)[^/]*[*?]", 1))
    fixed = F.when(whole, fixed).otherwise(F.regexp_replace(fixed, "/$", ""))
    return F.when(fixed == "", F.lit("/")).otherwise(fixed)


def detect_format(path: Column) -> Column:
    """csv, tsv, jsonl or text, by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(ext.isin("csv", "tsv"), ext).when(ext.isin("jsonl", "ndjson"), "jsonl").otherwise("text")
