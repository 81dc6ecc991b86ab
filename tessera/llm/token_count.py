"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import mapped, table

LIMIT = 512
#: Bytes of text handed to the tokenizer at once, and the length from which one text is split.
BATCH_BYTES, SPLIT_CHARS = 1 << 18, 1 << 16
#: Between a letter or digit and one space before a letter: the byte-level pre-tokenizer always
#: starts a new word at such a space, and no special token holds one.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])\x20(?=[A-Za-z])")


def pieces(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """``text`` cut at safe boundaries into pieces of about ``size``; longer where there is none."""
    out, start = [], 0
    while len(text) - start > size and (m := _SAFE.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


class _Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.model = self.encoder = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.encoder = Tokenizer.from_file(path)
            self.encoder.no_truncation()
            self.encoder.no_padding()

    def lengths(self, texts: list[str]) -> list[int]:
        if self.model:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [len(x) for x in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit`` under the tokenizer at ``path``.

    A ``.json`` file is read by tokenizers, a ``.model`` by sentencepiece; no begin, end or added
    tokens. Texts over ``SPLIT_CHARS`` are split where the byte-level pre-tokenizer splits too;
    this holds for byte-level files only, so other models encode them whole. Null counts as empty.
    Repeated rows each return, null ids too; other columns are ignored.
    """
    split = not path.endswith(".model") and '"pre_tokenizer":{"type":"ByteLevel"' in open(path, encoding="utf-8").read(4000).replace(" ", "").replace("\n", "")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(path)
        for batch in found:
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            counts, sizes = [0] * len(texts), [len(x.encode("utf-8")) for x in texts]
            held: list[str] = []
            of: list[int] = []
            total = 0

            def flush():
                for k, n in zip(of, counter.lengths(held), strict=True):
                    counts[k] += n
                held.clear()
                of.clear()

            for k, text in enumerate(texts):
                for piece in pieces(text) if split else [text]:
                    held.append(piece)
                    of.append(k)
                    total += len(piece) if piece.isascii() else len(piece.encode("utf-8"))
                    if total >= BATCH_BYTES:
                        flush()
                        total = 0
            flush()
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text")
    return mapped(own, batches, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
