"""SentencePiece encoding and decoding over a table of distinct marked words.

No piece of the model crosses from a character to a whitespace marker, and BPE merges never
look across such a place, so a text is the concatenation of its marked words (a run of markers
and what follows up to the next). Each distinct word is segmented once per task and its ids are
joined back by position; the table is local, because a corpus-wide one would have to move a row
per word occurrence. A model with crossing pieces or a normalizer is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import mapped, slices, table

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words held by a task's table; once over this it starts anew, so that memory stays bounded.
TABLE_WORDS = 200_000
#: A longer word is encoded apart and not held.
WORD_CHARS = 256
#: Bytes of texts that are looked up together.
PORTION_BYTES = 1 << 20


def splits(model_file: str) -> bool:
    """Whether words can be segmented one by one under this model."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    norm, kind = model.normalizer_spec, model.trainer_spec
    plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    own = all(x.type not in (4, 5) for x in model.pieces)  # user-defined or unused pieces
    return plain and own and kind.model_type == 2 and kind.byte_fallback and all(MARK not in x.piece.lstrip(MARK) for x in model.pieces)


class Codec:
    """Encodes and decodes whole texts; ``ids`` and ``decoded`` come from the word table."""

    def __init__(self, model_file: str, by_word: bool):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.by_word = by_word
        self.words: dict[str, tuple[str, int]] = {}
        self.changed: dict[str, str] = {}  # words that decode to something else
        size = range(self.model.get_piece_size())
        self.starting = np.array([self.model.id_to_piece(k).startswith(MARK) for k in size])
        self.special = np.array([self.model.is_byte(k) or self.model.is_unknown(k) or self.model.is_control(k) for k in size], np.int64)

    def _whole(self, text: str) -> tuple[str, str, int]:
        ids = self.model.encode(text)
        return ",".join(map(str, ids)), self.model.decode(ids), len(ids)

    def _learn(self, new: set[str]) -> None:
        """Puts marked words into the table, each given without its first marker, for the model
        puts one of its own before a text and drops its space when it decodes. Words with one
        marker are encoded as one text: an id whose piece begins with a marker starts a word.
        Pieces of the plain kind decode to themselves; words with others are decoded."""
        one = [x for x in new if len(x) > 1 and x[1] != MARK]
        ids = self.model.encode(" ".join([x[1:] for x in one])) if one else []
        found = np.array(ids, np.int64)
        starts = np.flatnonzero(self.starting[found])
        check = []
        if len(starts) == len(one):
            odd = np.add.reduceat(self.special[found], starts) if one else []
            texts = list(map(str, ids))
            cuts = [*starts.tolist(), len(ids)]
            for k, word in enumerate(one):
                self.words[word] = (",".join(texts[cuts[k] : cuts[k + 1]]), cuts[k + 1] - cuts[k])
            check = [(one[k], ids[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(odd)]
            new = new.difference(one)
        if rest := list(new):
            each = self.model.encode([x[1:] for x in rest], num_threads=1)
            each = [x or [self.model.piece_to_id(MARK)] for x in each]  # a marker alone at the end of a text
            check += zip(rest, each, strict=True)
            for word, x in zip(rest, each, strict=True):
                self.words[word] = (",".join(map(str, x)), len(x))
        if check:
            for (word, _), text in zip(check, self.model.decode([x for _, x in check], num_threads=1), strict=True):
                if " " + text != word.replace(MARK, " "):
                    self.changed[word] = " " + text

    def encode(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """(ids joined by commas, decoded text, number of ids) of each text."""
        if not self.by_word:
            return [self._whole(x) for x in texts]
        split = [_WORD.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        if len(self.words) > TABLE_WORDS:
            self.words.clear()
            self.changed.clear()
        known, changed = self.words, self.changed
        if new := set().union(*split).difference(known):
            self._learn(new)
        out = []
        for words, text in zip(split, texts, strict=True):
            rows = [known[x] for x in words]
            decoded = text.replace(MARK, " ")
            if changed and not changed.keys().isdisjoint(words):
                decoded = "".join([changed.get(x) or x.replace(MARK, " ") for x in words])[1:]
            out.append((",".join([r[0] for r in rows]), decoded, sum([r[1] for r in rows])))
        for x in new:
            if len(x) > WORD_CHARS:
                del known[x]
                changed.pop(x, None)
        return out


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``texts`` also
    ``ids`` (array of ints) and ``decoded``.

    Whole texts, without begin or end ids. Null counts as empty, which has no ids. Null ids and repeated rows
    each return; other columns are ignored.
    """
    by_word = splits(model_file)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file, by_word)
        digest = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
        for batch in found:
            for part in slices(batch, 1, PORTION_BYTES):
                rows = codec.encode([x or "" for x in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array([r[2] for r in rows], pa.int64()), pa.array([digest(r[0]) for r in rows], pa.string()), pa.array([digest(r[1]) for r in rows], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts:
                    columns += [pa.array([[int(i) for i in r[0].split(",") if i] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text"), batches, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
