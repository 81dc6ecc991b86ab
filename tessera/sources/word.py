"""Text of word-processor documents: OOXML packages, and the clean-up of the older format's text."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from tessera.errors import InvalidInput

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
#: Bytes of a package's text part.
PART_BYTES = 64 << 20
#: A field without fields inside: its instruction goes, its result, if it has one, stays.
_FIELD = re.compile("\x13[^\x13-\x15]*(?:\x14([^\x13-\x15]*))?\x15")
#: What the format's control characters stand for.
_MARKS = str.maketrans({"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x07": "\n", "\x1e": "-", "\x1f": None, "\x01": None, "\x02": None, "\x05": None, "\x08": None, "\x14": None, "\x15": None})


def clean_text(raw: str) -> str:
    """Plain text of the older format's: field instructions go and results stay, at any depth; paragraph,
    line, page and cell marks are line ends, a fixed hyphen is a hyphen, soft hyphens and anchors go."""
    while raw != (raw := _FIELD.sub(lambda m: m[1] or "", raw)):
        pass
    # a field that never ends: up to its result, or to the end
    raw = re.sub("\x13[^\x14]*(?:\x14|\\Z)", "", raw)
    return raw.translate(_MARKS)


def docx_text(data: bytes) -> str:
    """The text runs of a package, a line end a paragraph and break; deleted runs, field instructions
    and fallback copies are not text."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as package:
            if package.getinfo("word/document.xml").file_size > PART_BYTES:
                raise InvalidInput("the document is too large")
            root = ElementTree.fromstring(package.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise InvalidInput(f"not a document: {e}") from e
    out: list[str] = []

    def walk(node: ElementTree.Element) -> None:
        name = node.tag.rpartition("}")[2]
        if name == "Fallback":
            return
        if name == "t":
            out.append(node.text or "")
        for child in node:
            walk(child)
        out.append({"p": "\n", "br": "\n", "cr": "\n"}.get(name, "\t" if name == "tab" and not len(node) and not node.attrib else ""))

    walk(root)
    return "".join(out)


#: Extractors that need no more than the standard library; others are the caller's.
EXTRACTORS = {DOCX: docx_text}
