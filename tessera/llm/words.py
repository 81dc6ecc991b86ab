"""Words of Arrow text columns, cut byte by byte in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of bytes: part of a word, between words, the end of a piece.
WORD, GAP, BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte; bytes of characters beyond ASCII are parts of words."""
    out = np.full(256, WORD, np.uint8)
    out[list(gaps)] = GAP
    out[list(breaks)] = BREAK
    return out


def words(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words with A-Z lower-cased, the row of each, its piece) of all texts; null is empty.

    Pieces count up at each ``BREAK`` byte and need not start anew with a row. Takes some 15 bytes of
    memory a byte of text.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = kinds[raw]
    inside = kind == WORD
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    body = _LOWER[raw[inside]]
    cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(body))
    row = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), starts)
    return found, row, piece


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(index of each value, the different values); null is a value of its own."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    found = pc.dictionary_encode(values, null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
