"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with counts from a bounded
labelled sample. Statistics are frozen after training: a byte costs -log2 of its probability in
the longest known context, where the mass d / (n + d) of a context with n counts of d different
bytes escapes to the next shorter one, and the shortest escapes to all 256 bytes alike. The
language with the shortest exact code for the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import mapped, table

ORDER = 3
UNKNOWN = "und"
#: The sample: documents a language, none longer than this many characters, and about so many
#: characters over all languages, which share them alike; of each at least ``LEAST_DOCS`` beginnings.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL, LEAST_DOCS = 400, 20_000, 1 << 24, 16
#: Contexts of one order kept over all languages, the most frequent ones, and bytes of the cost tables.
MAX_CONTEXTS, MODEL_BYTES = 16_384, 128 << 20
#: Labels that can be learned; more are an error.
MAX_LABELS = 2_000
FOLDS, HELD_OUT = 4, 2
#: Bytes scored at once.
CHUNK = 1 << 18


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass
class Model:
    """Cost tables. ``symbol``: byte to class, 0 for bytes never seen; ``node``: the longest known
    context of the three classes before a byte; ``bits[l, node * classes + class]``."""

    langs: list[str]
    classes: int
    symbol: np.ndarray
    node: np.ndarray
    bits: np.ndarray

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language, shape (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)))
        held: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            held.append(k)
            size += len(text)
            if size >= CHUNK or k == len(texts) - 1:
                self._score([texts[i] for i in held], held, out)
                held, size = [], 0
        return out

    def _score(self, texts: list[bytes], rows: list[int], out: np.ndarray) -> None:
        pad = bytes(ORDER)
        raw = np.frombuffer(b"".join(pad + x for x in texts), np.uint8)
        sym = self.symbol[raw].astype(np.int32)
        ends = np.cumsum([len(x) + ORDER for x in texts])
        starts = ends - [len(x) + ORDER for x in texts]
        inside = np.ones(len(raw), bool)
        for k in range(ORDER):
            inside[starts + k] = False
            sym[starts + k] = 0
        if not inside.any():
            return
        key = np.zeros(len(raw) - ORDER, np.int32)
        for k in range(ORDER):
            key = key * self.classes + sym[k : len(raw) - ORDER + k]
        flat = self.node[key] * self.classes + sym[ORDER:]
        flat[~inside[ORDER:]] = -1
        for lang in range(len(self.langs)):
            cost = np.where(flat >= 0, self.bits[lang][flat], 0).astype(np.float64)
            total = np.concatenate([[0.0], np.cumsum(cost)])
            out[rows, lang] = total[np.maximum(ends - ORDER, 0)] - total[starts]


def _costs(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of classes in contexts with these counts, given those of the shorter contexts."""
    n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    whole = np.maximum(n + d, 1)
    return np.where(counts > 0, counts / whole, np.where(n > 0, d / whole, 1.0) * shorter)


def fit(samples: dict[str, list[bytes]], max_contexts: int = MAX_CONTEXTS) -> Model:
    """The frozen model of labelled texts."""
    langs = sorted(samples)
    seen = np.zeros(256, bool)
    joined = {}
    for lang in langs:
        joined[lang] = [np.frombuffer(x, np.uint8) for x in samples[lang]]
        for x in joined[lang]:
            seen[np.unique(x)] = True
    symbol = np.zeros(256, np.uint8 if seen.sum() < 255 else np.int16)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    a = int(seen.sum()) + 1
    grams = {}  # keys of ORDER + 1 classes by language
    singles = {}
    for lang in langs:
        parts, ones = [], np.zeros(a, np.int64)
        for x in joined[lang]:
            s = symbol[x].astype(np.int64)
            ones += np.bincount(s, minlength=a)
            s = np.concatenate([np.zeros(ORDER, np.int64), s])
            key = np.zeros(max(len(s) - ORDER, 0), np.int64)
            for k in range(ORDER + 1):
                key = key * a + s[k : len(s) - ORDER + k]
            parts.append(key)
        grams[lang] = np.unique(np.concatenate(parts or [np.zeros(0, np.int64)]), return_counts=True)
        singles[lang] = ones
    # nodes: 0 the empty context, then one byte, two bytes, and the frequent contexts of full order
    totals: dict[int, np.ndarray] = {}
    max_contexts = min(max_contexts, max(MODEL_BYTES // (4 * max(len(langs), 1) * a) // ORDER, 1))
    for order in range(1, ORDER + 1):
        found = [(k // a % a**order, c) for k, c in grams.values()]
        contexts, where = np.unique(np.concatenate([k for k, _ in found] or [np.zeros(0, np.int64)]), return_inverse=True)
        sums = np.bincount(where, np.concatenate([c for _, c in found] or [np.zeros(0)]), len(contexts))
        if len(contexts) > max_contexts:
            contexts = np.sort(contexts[np.argsort(-sums, kind="stable")[:max_contexts]])
        totals[order] = contexts
    node = np.zeros(a**ORDER, np.int32)
    first, base = 1, {0: 0}
    for order in range(1, ORDER + 1):
        base[order] = first
        for low in range(0, len(node), 1 << 20):  # some of the a**ORDER contexts at a time
            suffix = np.arange(low, min(low + (1 << 20), len(node))) % a**order
            at = np.searchsorted(totals[order], suffix)
            at[at == len(totals[order])] = 0
            if len(totals[order]):
                hit = totals[order][at] == suffix
                node[low : low + len(suffix)][hit] = first + at[hit]
        first += len(totals[order])
    bits = np.zeros((len(langs), first * a), np.float32)
    for row, lang in enumerate(langs):
        keys, counts = grams[lang]
        prob = np.zeros((first, a))
        zero = np.full((1, a), 1 / 256)
        prob[:1] = _costs(singles[lang][None].astype(float), zero)
        for order in range(1, ORDER + 1):
            contexts = totals[order]
            if not len(contexts):
                continue
            own = np.zeros((len(contexts), a))
            of = keys // a % a**order
            at = np.minimum(np.searchsorted(contexts, of), len(contexts) - 1)
            ok = contexts[at] == of
            np.add.at(own, (at[ok], keys[ok] % a), counts[ok])
            suffix = contexts % a ** (order - 1)
            up = np.zeros(len(contexts), np.int64)
            for low in range(1, order):  # the longest known shorter context
                pos = np.searchsorted(totals[low], suffix % a**low)
                pos[pos == len(totals[low])] = 0
                hit = totals[low][pos] == suffix % a**low
                up[hit] = base[low] + pos[hit]
            prob[base[order] : base[order] + len(contexts)] = _costs(own, prob[up])
        bits[row] = -np.log2(np.maximum(prob, 1e-12)).astype(np.float32).ravel()
    return Model(langs, a, symbol, node, bits)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int) -> dict[str, list[bytes]]:
    """About ``sample_docs`` training documents of each language, chosen by a hash of the id; of a
    language without a text of up to ``SAMPLE_CHARS`` characters, what its texts begin with. Of many
    languages each has fewer documents, so that the driver holds about ``SAMPLE_TOTAL`` characters."""
    usable = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)
    )
    short = F.length("text") <= SAMPLE_CHARS
    # without letters or of no length, a short text teaches nothing
    fit_ = short & F.col("text").rlike(r"\p{L}")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(fit_).alias("fit"), F.avg(F.when(fit_, F.length("text"))).alias("mean"))
    counts = counts.orderBy("lang").limit(MAX_LABELS + 1).collect()
    if not counts:
        return {}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages to learn")
    quota = SAMPLE_TOTAL // len(counts)
    wanted = {r["lang"]: max(min(sample_docs, int(quota / (r["mean"] or SAMPLE_CHARS))), LEAST_DOCS) for r in counts}
    chars = min(SAMPLE_CHARS, max(quota // LEAST_DOCS, 1))
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, wanted[r["lang"]] / (r["fit"] or r["n"])))])
    long_only = [r["lang"] for r in counts if not r["fit"]]
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(rate, F.col("lang")) * 1_000_000
    taken = short | F.col("lang").isin(long_only) if long_only else short
    rows = usable.where(drawn & taken).select("lang", "doc_id", F.left("text", F.lit(chars)).alias("text")).collect()
    found: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        if len(found[r["lang"]]) < 2 * wanted[r["lang"]]:
            found[r["lang"]].append(r["text"].encode("utf-8"))
    return found


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, share of the probability, bits a byte) of each text."""
    texts = ["" if x is None else x for x in texts]
    if not model.langs or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    raw = [x.encode("utf-8") for x in texts]
    letters = np.array([any(map(str.isalpha, x)) for x in texts])
    bits = model.code_lengths(raw)
    low = bits.min(1)
    share = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
    langs = [model.langs[b] if ok else UNKNOWN for b, ok in zip(bits.argmin(1), letters, strict=True)]
    return langs, np.where(letters, np.round(share, 6), 0.0), low / np.maximum([len(x) for x in raw], 1)


def shipped(spark: SparkSession, model: Model):
    """A broadcast of the model's fields, plain values that a worker without this package can read;
    the cost tables, by far the largest, hold at most ``MODEL_BYTES`` whatever the number of languages,
    and the table of contexts four bytes for each three bytes that can follow one another, 68 MB at most."""
    return spark.sparkContext.broadcast((model.langs, model.classes, model.symbol, model.node, model.bits))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, model: Model | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, bits_per_byte``.

    ``lang_pred`` is ``und`` where the text is null or has no letter, and where nothing could be
    learned; its score is 0. Otherwise the score is the winner's share of the probability that
    the code lengths stand for. Ties go to the language first in order. Null ids are not held
    out and not learned from. Repeated rows each return; other columns are ignored.
    """
    model = model or fit(labelled_sample(docs, id_col, text_col, lang_col, sample_docs))
    shared = shipped(docs.sparkSession, model)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            preds, scores, rates = predict(Model(*shared.value), batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col)) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return mapped(own, batches, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that are in some language, with all their columns; ``und`` ones go. No shuffle."""
    model = fit(labelled_sample(docs, id_col, text_col, lang_col, sample_docs))
    at = docs.columns.index(text_col)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            preds, _, _ = predict(Model(*shared.value), batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN for x in preds], pa.bool_()))

    shared = shipped(docs.sparkSession, model)
    return mapped(docs, batches, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
