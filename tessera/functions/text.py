"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

INLINE_BYTES = 256 * 1024
#: Words, lower-cased: each Han character, else runs of letters and digits.
TOKEN = r"\p{IsHan}|(?:[^\P{L}\p{IsHan}]|\p{N})+"
_CHAR = r"(?:[^\P{L}\p{IsHan}]|\p{N})"
#: The same with runs of Han characters as overlapping pairs, a lone one by itself; found by looking ahead, so
#: that matches may overlap.
BIGRAM = rf"(?=(\p{{IsHan}}{{2}}|(?<!\p{{IsHan}})\p{{IsHan}}(?!\p{{IsHan}})|(?<!{_CHAR}){_CHAR}+))"
#: Patterns of tokenisers by name, the group that is the token, and a version for what was stored with them.
TOKENISERS = {"words": (TOKEN, 0, 1), "bigrams": (BIGRAM, 1, 1)}
#: The characters with the property White_Space.
SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CUT_MARK = "\n\n[... content truncated ...]\n\n"
HAN, KANA_HANGUL = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]", r"[\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"

_SPACES = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), SPACE)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def stripped(value: str) -> str:
    """``trimmed`` of a literal."""
    return re.sub(rf"\A{_SPACES}+|{_SPACES}+\Z", "", value)


def composed(text: Column) -> Column:
    """In normal form C."""

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))

    return normal(text)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def lines(text: Column) -> Column:
    """Lines without their ends; one final newline opens no line, and empty text has none."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n", -1), lambda s: F.regexp_replace(s, r"\r\z", "")))


def line_count(text: Column) -> Column:
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("int")


def storage_tier(text: Column) -> Column:
    return F.when(F.octet_length(text) <= INLINE_BYTES, "inline").otherwise("chunked")


def ascii_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def token_estimate(text: Column) -> Column:
    """One token for four ASCII characters, rounded up, and one for each other character."""
    n = ascii_count(text)
    return (F.ceil(n / 4) + F.length(text) - n).cast("long")


def is_binary(text: Column) -> Column:
    return F.contains(text, F.lit("\x00"))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def truncated_middle(text: Column, n: int) -> Column:
    half = F.lit(n // 2)
    return F.when(F.length(text) > n, F.concat(F.left(text, half), F.lit(CUT_MARK), F.right(text, half))).otherwise(text)


def without_front_matter(text: Column) -> Column:
    """The text after a leading block between two ``---`` lines; an open block is text."""
    return F.regexp_replace(text, r"\A---[^\S\n]*\n(?:(?!---[^\S\n]*(?:\n|\z))[^\n]*\n)*?---[^\S\n]*(?:\n|\z)", "")


def output_language(text: Column) -> Column:
    """zh-CN where over a quarter of the first 500 characters is Han and kana or hangul are few, else en."""
    sample = F.left(text, F.lit(500))
    han, other = F.regexp_count(sample, F.lit(HAN)), F.regexp_count(sample, F.lit(KANA_HANGUL))
    return F.when((han * 4 > F.length(sample)) & (other * 4 <= han), "zh-CN").otherwise("en")


def citation_indices(text: Column) -> Column:
    """The numbers of ``[n]`` markers in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda s: s.cast("int"))


def tokens(text: Column, tokeniser: str = "words") -> Column:
    pattern, group, _ = TOKENISERS[tokeniser]
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(group))


def tokens_of(value: str, tokeniser: str = "words") -> list[str]:
    """``tokens`` of a literal."""
    pattern, group, _ = TOKENISERS[tokeniser]
    return [m[group] for m in regex.finditer(pattern.replace("IsHan", "Han"), value.lower())]


def rfc3339(ts: Column) -> Column:
    """A UTC timestamp as text; a fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def mask_token(token: Column) -> Column:
    return F.when(F.octet_length(token) <= 12, "****").otherwise(F.concat(F.left(token, F.lit(7)), F.lit("…"), F.right(token, F.lit(4))))


def like_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def mime_type(data: Column) -> Column:
    """By magic bytes; text where none fits and the bytes are valid UTF-8."""
    head = lambda n: F.hex(F.substring(data, 1, n))
    word = F.contains(F.hex(data), F.lit("57006F007200640044006F00630075006D0065006E007400"))
    return (
        F.when(head(5) == "255044462D", "application/pdf")
        .when(head(8) == "89504E470D0A1A0A", "image/png")
        .when(head(3) == "FFD8FF", "image/jpeg")
        .when(head(4) == "47494638", "image/gif")
        .when((head(4) == "52494646") & (F.hex(F.substring(data, 9, 4)) == "57454250"), "image/webp")
        .when((head(4) == "504B0304") & F.contains(F.hex(data), F.lit("776F72642F")), "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .when((head(8) == "D0CF11E0A1B11AE1") & word, "application/msword")
        .when(F.is_valid_utf8(data.cast("string")), "text/plain")
        .otherwise("application/octet-stream")
    )


def source_type(mime: Column) -> Column:
    return (
        F.when(mime == "application/pdf", "pdf")
        .when(mime.contains("word"), "word")
        .when(mime.startswith("image/"), "image")
        .when(mime == "text/plain", "text")
        .otherwise("binary")
    )
