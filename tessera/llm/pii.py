"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, schemes, plus signs, digits, identifier
cues) in one pass over a text; a local parser expands each anchor to its boundaries and
validates it. Cost is linear in the text: no parser looks left of its kind's last match.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import mapped, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login_url", "handle", "account")
CUES = ("account", "acct", "iban", "password", "passwd", "token", "api_key", "apikey", "secret", "username", "login", "ssn", "passport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\x00-\x20/?#\"<>@]+@[^\x00-\x20\"<>]+")
_HANDLE = re.compile(r"[A-Za-z0-9_]{2,30}(?![A-Za-z0-9_.@-])")
_VALUE = re.compile(r"(?:\x20(?:no\.?|number|id))?\x20{0,3}[:=#]\x20{0,3}[\"']?([A-Za-z0-9_-]{4,128})(?![A-Za-z0-9_-])")
_DIGIT = re.compile(r"[0-9]")


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    for text, what in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(text, (what, len(text)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def find(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of every span in ``text``, sorted."""
    spans: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = url_end = cue_end = 0
    ip_run = -1  # end of the digit run last tried as an address
    for last, (what, size) in anchors.iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, 2, card_end))
            if at >= ip_end and at != ip_run:
                if m := _IP.match(text, at):
                    ip_end = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
                        spans.append((at, 1, ip_end))
            ip_run = at + 1  # a digit that follows at once belongs to a run already tried
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans.append((start, 0, email_end))
            elif start == at and (at == 0 or not text[at - 1].isalnum()) and (m := _HANDLE.match(text, at + 1)):
                spans.append((at, 5, m.end()))
        elif what == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    spans.append((at, 3, phone_end))
        elif what == "scheme":
            start = at
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _USERINFO.match(text, last + 1)):
                url_end = m.end()
                spans.append((start, 4, url_end))
        elif at >= cue_end and (at == 0 or not text[at - 1].isalnum()) and (m := _VALUE.match(text, last + 1)):
            cue_end = m.end(1)
            if _DIGIT.search(m[1]):
                spans.append((m.start(1), 6, cue_end))
    spans.sort()
    return spans


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = find(text or "", anchors)
            base = [x for x in spans if x[1] < len(BASE)]
            counts = [sum(x[1] == k for x in base) for k in range(len(BASE))]
            rows.append((doc_id, *counts, hashlib.sha256(named(base).encode()).hexdigest(), named(spans)))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT) if rows else pa.RecordBatch.from_pylist([], _OUT)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    ``spans`` are ``kind:start:end`` in code points, end exclusive. Base kinds are the four
    counted; the method adds ``login_url`` (a URL with user info), ``handle`` (@name) and
    ``account`` (a value with a digit after an identifier cue). Null and empty texts have none.
    Null ids and repeated rows each return; other columns are ignored.
    """
    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return mapped(docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text"), _batches, out)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
