"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector, if it was learned, and as the strongest response of character filters
along its bytes. The network reads overlapping windows of words both ways; attention weighs the states
of a window into one vector, whose logit is the window's. A text's logit is the mean of its windows'
logits, weighed by their exponentials, so that one toxic window is enough. Trained in numpy on a bounded
sample of labelled texts in the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import mapped, slices, table
from tessera.llm.words import classes, words

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: The sample: texts of label 1 and of label 0 at most, none longer than so many characters.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1_200, 1_800, 4_000
#: Words of a window, words between the starts of two.
WINDOW, STRIDE = 96, 80
#: Word vectors, the most documents' first; their width; character filters and their width in bytes; states a direction.
VOCABULARY, WORD_DIM, FILTERS, WIDTH, STATES, ATTENTION = 20_000, 12, 24, 5, 12, 12
#: At most so many passes over the sample, and about so many texts seen in all of them.
PASSES, TEXTS_SEEN, BATCH, RATE, DROPPED, SEED = 40, 12_000, 32, 0.006, 0.3, 7
#: Letters, digits and all beyond ASCII make words.
KINDS = classes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Bytes of words, and windows, that are computed at once.
BYTES_AT_ONCE, WINDOWS_AT_ONCE = 1 << 15, 1_024
#: Words whose inputs a task keeps, 288 bytes each besides the word.
WORDS_KEPT = 200_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def fresh(vocabulary: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Parameters before training. Row 0 of the word vectors stands for unknown words."""
    make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    inputs = WORD_DIM + FILTERS
    return {
        "word": make(vocabulary + 1, WORD_DIM, scale=0.1),
        "char": make(WIDTH, 257, FILTERS, scale=0.3),
        "char_bias": np.zeros(FILTERS, np.float32),
        "in": make(2, inputs, 3 * STATES, scale=inputs**-0.5),
        "in_bias": np.zeros((2, 1, 3 * STATES), np.float32),
        "state": make(2, STATES, 3 * STATES, scale=STATES**-0.5),
        "att": make(2 * STATES, ATTENTION, scale=(2 * STATES) ** -0.5),
        "att_bias": np.zeros(ATTENTION, np.float32),
        "att_out": make(ATTENTION, scale=ATTENTION**-0.5),
        "out": make(2 * STATES, scale=(2 * STATES) ** -0.5),
        "out_bias": np.zeros(1, np.float32),
    }


# words


def spelled(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, each in ``<`` and ``>`` and followed by blanks (256), where each starts)."""
    raw = np.frombuffer(b"".join(b"<" + x + b">" for x in names), np.uint8).astype(np.int32)
    sizes = np.array([len(x) + 2 for x in names], np.int64)
    starts = np.cumsum(sizes) - sizes + (WIDTH - 1) * np.arange(len(names))
    out = np.full(len(raw) + (WIDTH - 1) * len(names), 256, np.int32)
    out[np.arange(len(raw)) + np.repeat((WIDTH - 1) * np.arange(len(names)), sizes)] = raw
    return out, starts


def characters(params: dict, names: list[bytes], backward: bool = False):
    """The strongest response of each filter along each word, and if asked the bytes that gave it."""
    text, starts = spelled(names)
    ends = np.append(starts[1:], len(text)) - (WIDTH - 1)
    best, where = np.zeros((len(names), FILTERS), np.float32), np.zeros((len(names), FILTERS), np.int64)
    a = 0
    while a < len(names):  # some words at a time, of any length
        b = max(int(np.searchsorted(ends, starts[a] + BYTES_AT_ONCE)), a + 1)
        for low in range(int(starts[a]), int(ends[b - 1]), BYTES_AT_ONCE):  # more than once for one very long word only
            high = min(low + BYTES_AT_ONCE, int(ends[b - 1])) if b == a + 1 else int(ends[b - 1])
            at = np.arange(low, high)
            owner = np.searchsorted(starts[a:b], at, side="right") - 1
            at, owner = at[at < ends[a + owner]], owner[at < ends[a + owner]]
            score = params["char"][0][text[at]]
            for k in range(1, WIDTH):
                score = score + params["char"][k][text[at + k]]
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            top = np.maximum.reduceat(score, cuts) + params["char_bias"]
            rows = a + owner[cuts]
            if backward:
                hit = score + params["char_bias"] >= np.repeat(top, np.diff(np.append(cuts, len(at))), 0)
                pos, filt = np.nonzero(hit)
                better = top > best[rows]
                ok = better[np.searchsorted(cuts, pos, side="right") - 1, filt]
                where[a + owner[pos[ok]], filt[ok]] = at[pos[ok]]
            best[rows] = np.maximum(best[rows], top)
            if b > a + 1:
                break
        a = b
    return (best, where, text) if backward else best


# windows


def run_windows(params: dict, projected: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows of word ids, shape (windows, words). ``projected``: (2, words, 3 * STATES)."""
    n, length = ids.shape
    h = np.zeros((2, n, STATES), np.float32)
    states = np.empty((length, 2, n, STATES), np.float32)
    tape = []
    both = np.stack([ids, ids[:, ::-1]]), np.stack([mask, mask[:, ::-1]])
    whole = both[1].all((0, 1))
    for t in range(length):
        x = np.stack([projected[0][both[0][0][:, t]], projected[1][both[0][1][:, t]]])
        m = both[1][:, :, t, None]
        u = h @ params["state"]
        gate = _sigmoid(x[..., : 2 * STATES] + u[..., : 2 * STATES])
        r, z = gate[..., :STATES], gate[..., STATES:]
        new = np.tanh(x[..., 2 * STATES :] + r * u[..., 2 * STATES :])
        after = new + z * (h - new)
        if not whole[t]:
            after = np.where(m, after, h)
        if keep:
            tape.append((h, r, z, new, u[..., 2 * STATES :], m))
        h = after
        states[t] = h
    hidden = np.concatenate([states[:, 0], states[::-1, 1]], 2).transpose(1, 0, 2)
    seen = np.tanh(hidden @ params["att"] + params["att_bias"])
    weight = seen @ params["att_out"]
    weight = np.where(mask, weight, -1e9)
    weight = np.exp(weight - weight.max(1, keepdims=True)) * mask
    weight = weight / np.maximum(weight.sum(1, keepdims=True), 1e-9)
    pooled = (weight[:, None] @ hidden)[:, 0]
    logits = pooled @ params["out"] + params["out_bias"]
    return (logits, (tape, hidden, seen, weight, pooled, both[0])) if keep else logits


def _back_windows(params: dict, kept, ids: np.ndarray, mask: np.ndarray, grad: np.ndarray, words_: int) -> dict[str, np.ndarray]:
    tape, hidden, seen, weight, pooled, both = kept
    g = {"out": grad @ pooled, "out_bias": grad.sum(keepdims=True)}
    d_pooled = grad[:, None] * params["out"]
    d_hidden = weight[..., None] * d_pooled[:, None]
    d_weight = (hidden @ d_pooled[..., None])[..., 0]
    d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
    g["att_out"] = d_score.ravel() @ seen.reshape(-1, ATTENTION)
    d_pre = d_score[..., None] * params["att_out"] * (1 - seen * seen)
    g["att"] = hidden.reshape(-1, 2 * STATES).T @ d_pre.reshape(-1, ATTENTION)
    g["att_bias"] = d_pre.sum((0, 1))
    d_hidden = d_hidden + d_pre @ params["att"].T
    d_states = np.stack([d_hidden[..., :STATES], d_hidden[:, ::-1, STATES:]])
    g["state"] = np.zeros_like(params["state"])
    d_x = np.empty((2, *ids.shape, 3 * STATES), np.float32)
    dh = np.zeros_like(tape[0][0])
    for t in range(len(tape) - 1, -1, -1):
        h, r, z, new, un, m = tape[t]
        dh = dh + d_states[:, :, t]
        dm = np.where(m, dh, 0)
        d_new = dm * (1 - z) * (1 - new * new)
        d_z = dm * (h - new) * z * (1 - z)
        d_r = d_new * un * r * (1 - r)
        d_u = np.concatenate([d_r, d_z, d_new * r], 2)
        d_x[:, :, t] = np.concatenate([d_r, d_z, d_new], 2)
        g["state"] += h.transpose(0, 2, 1) @ d_u
        dh = np.where(m, dm * z, dh) + d_u @ params["state"].transpose(0, 2, 1)
    d_projected = np.zeros((2, words_, 3 * STATES), np.float32)
    for k in (0, 1):
        flat = both[k].ravel()
        order = np.argsort(flat, kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        d_projected[k][found] = np.add.reduceat(d_x[k].reshape(len(flat), -1)[order], first)
    g["projected"] = d_projected
    return g


def cut_windows(lengths: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows of texts of so many words; a text without words has none."""
    many = np.where(lengths > 0, 1 + -(-np.maximum(lengths - window, 0) // stride), 0)
    text = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, k * stride, np.minimum(window, lengths[text] - k * stride)


def filled(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of windows that begin at ``first`` of all ``ids``, padded to the longest."""
    at = np.arange(int(size.max()))
    mask = at < size[:, None]
    return np.where(mask, ids[np.minimum(first[:, None] + at, len(ids) - 1)], 0), mask


def pooled(logits: np.ndarray, text: np.ndarray, texts: int, blank: float) -> tuple[np.ndarray, np.ndarray]:
    """(logit of each text, weight of each window); ``blank`` for texts without windows."""
    top = np.full(texts, -np.inf)
    np.maximum.at(top, text, logits)
    e = np.exp(logits - top[text])
    share = e / np.bincount(text, e, texts)[text] if len(text) else e
    return np.where(np.isfinite(top), np.bincount(text, share * logits, texts), blank), share


# training


def fit(texts: list[bytes], labels: np.ndarray, epochs: int | None = None, seed: int = SEED) -> dict:
    """The trained model: parameters and the ids of known words."""
    rng = np.random.default_rng(seed)
    split = [[x.as_py().encode() for x in words(pa.array([t.decode()], pa.string()), KINDS)[0]] for t in texts]
    counts = Counter(w for x in split for w in set(x))
    known = {w: k + 1 for k, w in enumerate(sorted((w for w, c in counts.items() if c > 1), key=lambda w: (-counts[w], w))[:VOCABULARY])}
    params = fresh(len(known), rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    weight = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
    weight = weight**0.5
    usable = np.array([k for k, x in enumerate(split) if x], np.int64)
    epochs = epochs or max(1, min(PASSES, round(TEXTS_SEEN / max(len(usable), 1))))
    step = 0
    total = epochs * -(-len(usable) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(usable)
        for begin in range(0, len(order), BATCH):
            batch = order[begin : begin + BATCH]
            flat = [w for k in batch for w in split[k]]
            names = sorted(set(flat))
            at = {w: k for k, w in enumerate(names)}
            ids = np.array([at[w] for w in flat], np.int64)
            lengths = np.array([len(split[k]) for k in batch], np.int64)
            text, first, size = cut_windows(lengths)
            first = first + (np.cumsum(lengths) - lengths)[text]
            own = np.array([known.get(w, 0) for w in names], np.int64)
            own[rng.random(len(own)) < DROPPED] = 0
            chars, where, spelling = characters(params, names, backward=True)
            inputs = np.concatenate([params["word"][own], chars], 1)
            projected = inputs @ params["in"] + params["in_bias"]
            block, mask = filled(ids, first, size)
            logits, kept = run_windows(params, projected, block, mask, keep=True)
            score, share = pooled(logits, text, len(batch), 0.0)
            wrong = weight[batch] * (_sigmoid(score) - labels[batch]) / len(batch)
            grad = (wrong[text] * share * (1 + logits - score[text])).astype(np.float32)
            g = _back_windows(params, kept, block, mask, grad, len(names))
            d_projected = g.pop("projected")
            g["in"] = inputs.T @ d_projected
            g["in_bias"] = d_projected.sum(1, keepdims=True)
            d_inputs = (d_projected @ params["in"].transpose(0, 2, 1)).sum(0)
            g["word"] = np.zeros_like(params["word"])
            np.add.at(g["word"], own, d_inputs[:, :WORD_DIM])
            d_chars = np.where(chars > 0, d_inputs[:, WORD_DIM:], 0)
            g["char_bias"] = d_chars.sum(0)
            filt = np.broadcast_to(np.arange(FILTERS), where.shape)
            g["char"] = np.stack([np.bincount((spelling[where + k] * FILTERS + filt).ravel(), d_chars.ravel(), 257 * FILTERS).reshape(257, FILTERS) for k in range(WIDTH)])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (total + 1)))
            for k, x in g.items():
                x = x * min(1.0, 5 / max(norm, 1e-9))
                one, two = moments[k]
                one += 0.1 * (x - one)
                two += 0.001 * (x * x - two)
                params[k] -= (rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return {"known": known, **params}


class Inputs:
    """What the network reads of words, kept from one batch to the next; emptied at ``WORDS_KEPT`` words."""

    def __init__(self, model: dict):
        self.model, self.at = model, {}
        self.rows = np.empty((2, 0, 3 * STATES), np.float32)
        self.used = 0

    def of(self, names: list[str]) -> np.ndarray:
        """The row in ``rows`` of each word."""
        if self.used + len(names) > WORDS_KEPT:
            self.at, self.used = {}, 0
        found = [self.at.get(w) for w in names]
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            raw = [names[k].encode() for k in new]
            own = np.array([self.model["known"].get(w, 0) for w in raw], np.int64)
            made = np.concatenate([self.model["word"][own], characters(self.model, raw)], 1) @ self.model["in"] + self.model["in_bias"]
            end = self.used + len(new)
            if end > self.rows.shape[1]:
                wider = np.empty((2, max(end, 2 * self.rows.shape[1]), 3 * STATES), np.float32)
                wider[:, : self.used] = self.rows[:, : self.used]
                self.rows = wider
            self.rows[:, self.used : end] = made
            for k, x in zip(new, range(self.used, end), strict=True):
                self.at[names[k]] = found[k] = x
            self.used = end
        return np.array(found, np.int64)


def scores(model: dict, texts: pa.Array, inputs: Inputs | None = None) -> np.ndarray:
    """The score of each text, from all its windows."""
    found, row, _ = words(texts, KINDS)
    blank = float(model["out_bias"][0])
    if not len(found):
        return np.full(len(texts), _sigmoid(np.float64(blank)))
    coded = found.dictionary_encode()
    inputs = inputs or Inputs(model)
    ids = inputs.of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    lengths = np.bincount(row, minlength=len(texts))
    text, first, size = cut_windows(lengths)
    first = first + (np.cumsum(lengths) - lengths)[text]
    logits = np.empty(len(text))
    order = np.argsort(size, kind="stable")
    for a in range(0, len(order), WINDOWS_AT_ONCE):
        some = order[a : a + WINDOWS_AT_ONCE]
        logits[some] = run_windows(model, inputs.rows, *filled(ids, first[some], size[some]))
    return _sigmoid(pooled(logits, text, len(texts), blank)[0])


# Spark


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[bytes], np.ndarray]:
    """At most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` texts outside the held-out fold, chosen by a hash of the
    id, of up to ``SAMPLE_CHARS`` characters; where a label has only longer ones, what those begin with."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    own = docs.select(F.col(id_col).alias("doc_id"), F.length(text_col).alias("size"), F.left(F.col(text_col), F.lit(SAMPLE_CHARS)).alias("text"))
    texts: list[bytes] = []
    marks: list[int] = []
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        # half as many again, as some have long texts or none
        ids = usable.where(F.col("label") == label).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most + most // 2)
        rows = own.join(F.broadcast(ids), "doc_id").where(F.length("text") > 0).orderBy(F.col("size") > SAMPLE_CHARS, F.xxhash64("doc_id"), "doc_id", "text").limit(most).collect()
        short = [r for r in rows if r["size"] <= SAMPLE_CHARS]
        texts += [r["text"].encode() for r in short or rows]
        marks += [label] * len(short or rows)
    return texts, np.array(marks)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    A null or empty text, or one without a word, has the score of a window of weight zero. Where the
    labels teach only one class, all scores are that class; without any they are 0. Null ids are
    neither learned from nor held out; repeated rows each return; ids labelled both ways teach both.
    Other columns are ignored.
    """
    texts, marks = labelled_sample(docs, labels, id_col, text_col, label_col)
    model = fit(texts, marks) if len(set(marks.tolist())) == 2 else None
    only = float(marks[0]) if len(marks) else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        inputs = Inputs(model) if model else None
        for whole in found:
            for batch in slices(whole, 2):
                score = np.full(batch.num_rows, only) if model is None else scores(model, batch.column(2), inputs)
                columns = [batch.column(0), batch.column(1), pa.array(np.round(score, 6)), pa.array((np.round(score, 6) >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col)) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return mapped(own, batches, "doc_id long, held_out boolean, score double, predicted int")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
