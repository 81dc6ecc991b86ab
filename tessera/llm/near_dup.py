"""Near-duplicates by a chosen-path set similarity join.

Every document is a set of word shingles with ``TREES`` minwise roots and ``COORDINATES`` minwise
tokens of a byte. In each of the independent trees a document goes down the paths its tokens
choose: a node holds the documents with equal tokens at the coordinates chosen so far.

* First each document is compared with the hub (the least row) of each of its root nodes, and
  what the sketches let pass is confirmed on full sets. The links found make classes.
* A node whose documents outside its largest class number ``LEAF`` or fewer is compared
  exhaustively: those documents with all others, in chunks of bounded size, by their sketches.
* Any other node branches, on one further coordinate or on two, as its own hash decides.
* What the sketches let pass is confirmed on full sets, a chunk's documents at once.

So rows grow with documents, not with pairs, and the trees decide recall, never precision. Two
sets at similarity 0.8 share a root with probability 0.8. Below a large node they stay together at
a level with 0.8 or 0.96, 0.88 in the mean, which leaves 0.625 at any depth (the solution of
q = (0.8 q + 1 - (1 - 0.8 q) ** 2) / 2). In twelve trees they miss each other with at most
(1 - 0.8 * 0.625) ** 12 = 0.00025, where every node is large; a sketch errs with 0.0002. A document
with ``DONE`` or fewer large roots goes down none of them: a pair without a common small root has
so few with 0.0001 or less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import mapped, release, scratch, slices, stored, table, unused

WORDS, PERCENT = 5, 80
TREES, COORDINATES = 12, 256
#: Documents outside a node's largest class up to which it is compared exhaustively.
LEAF = 512
#: Large roots up to which a document's other trees suffice.
DONE = 3
#: Levels of branching; what is still large below them is compared exhaustively all the same.
LEVELS = 24
#: Equal tokens, of 256, from which two sets become candidates: 0.8 less 3.5 deviations; and those
#: of the first 64 without which the others are not looked at: 0.8 less 4.5 deviations.
CANDIDATE, FIRST, GLANCE = 182, 64, 37
#: Documents, and shingles, of a node compared in one task besides those outside its largest class.
CHUNK, BULK = 512, 1 << 20
#: Links contracted in one task.
EDGES = 1 << 20
#: Columns of a membership matrix held at once.
COLUMNS = 1 << 13
#: Word hashes held by a task.
TABLE_WORDS = 250_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, 2 * (TREES + COORDINATES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD, _ADD = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]
_ODD_32, _ADD_32 = (x[TREES:].astype(np.uint32)[:, None] for x in (_ODD, _ADD))


class _Hashes(dict):
    """Word to 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Distinct shingle hashes of a text: words are runs without ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes = words, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.hashes) > TABLE_WORDS:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(h))
        mixed = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = _mixed(mixed + h[k : len(h) - n + 1 + k])
        return np.unique(mixed)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums over the set, 64 bits each: equal sets have equal ones."""
    one = shingles.sum(dtype=np.uint64)
    two = _mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """The minwise roots, 8 bytes each, then the minwise tokens, a byte each."""
    roots = np.full(TREES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 512):  # bounds memory for very long texts, and stays in cache
        part = shingles[at : at + 512]
        roots = np.minimum(roots, (part * _ODD[:TREES, None] + _ADD[:TREES, None]).min(1))
        half = (part >> np.uint64(32)).astype(np.uint32)
        low = np.minimum(low, (half * _ODD_32 + _ADD_32).min(1))
    return roots.tobytes() + (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def _sketches(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Roots and tokens of rows of sketches."""
    raw = np.frombuffer(b"".join(tokens), np.uint8).reshape(len(tokens), 8 * TREES + COORDINATES)
    return np.ascontiguousarray(raw[:, : 8 * TREES]).view(np.uint64), raw[:, 8 * TREES :]


def _passes(tokens: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets i[k] and j[k] can be linked, by their sizes and sketches."""
    out = 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
    first = np.ascontiguousarray(tokens[:, :FIRST])
    for rows, least in ((first, GLANCE), (tokens, CANDIDATE)):
        left = np.flatnonzero(out)
        for at in range(0, len(left), 4096):
            k = left[at : at + 4096]
            out[k] = np.count_nonzero(rows[i[k]] == rows[j[k]], axis=1) >= least
    return out


def _sketched(words: int) -> Callable:
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(words)
        for batch in (x for whole in found for x in slices(whole, 1)):
            sizes, sums, tokens = [], [], []
            for text in batch.column(1).to_pylist():
                x = of(text)
                sizes.append(len(x))
                sums.append(fingerprint(x))
                tokens.append(sketch(x) if len(x) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), *[pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)], pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "tokens"])

    return batches


def _groups(found: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns, of sorted input; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in found:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != tuple(c[0] for c in cols)
        at = 0
        for cut in np.flatnonzero(change):
            if cut > at:
                held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _classes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the least node of its class) of the nodes of the links u, v that are not least."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    below = up != np.arange(len(nodes))
    return nodes[below], nodes[up[below]]


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _contracted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v -> as few links that connect the same, ``EDGES`` at once."""
    held, n = [], 0
    for batch in found:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES:
            yield _edges(*_classes(*(np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1))))
            held, n = [], 0
    if n:
        yield _edges(*_classes(*(np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1))))


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """node, root (the component's smallest node) of every node of ``edges`` (u, v).

    Links are dealt to tasks of up to ``most``, each of which leaves a forest. Where that took
    several tasks, alternating large-star and small-star steps follow until only stars are left,
    each written to the shared folder. A node's neighbours are only aggregated over and joined
    with, so its degree may be of any size.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges", rows=F.count(F.lit(1)))
    while True:
        tasks = -(-edges.observed["rows"] // most) or 1
        whole = stored(mapped(edges.repartition(tasks), _contracted, "u long, v long"), "forest")
        release(edges)
        edges = whole
        if tasks == 1:
            break
        both = edges.union(edges.select("v", "u"))
        # stored, so that the join shuffles both sides and a centre's many rows can be split
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least.hint("merge"), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least_of = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least_of, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        stars = stored(small.where("u <> v").distinct(), "stars", rows=F.count(F.lit(1)))
        release(edges, least)
        edges = stars
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below")).union(edges.select(F.col("v").alias("node"), F.lit(1000).alias("below")))
        # a star forest: each node hangs under one other, or others under it
        held = ends.groupBy("node").agg(F.min("below").alias("least"), F.max("below").alias("most"), F.count_if(F.col("below") == 1).alias("ups"))
        if held.where("ups > 1 or least <> most").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs j < k of a block whose sets are linked, by exact counts: products of membership
    matrices over the shingles that several sets share, some columns at a time."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    shingles, at, times = np.unique(every, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    keep = times[at] > 1
    place = np.cumsum(times > 1) - 1
    owner, column = owner[keep], place[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.int64)
    for start in range(0, int((times > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        inside = np.zeros((n, min(COLUMNS, int((times > 1).sum()) - start)), np.float32)
        inside[owner[lo:hi], column[lo:hi] - start] = 1
        common += (inside @ inside.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu((common > 0) & (100 * common >= percent * union), 1))


def _confirmed(words: int, percent: int) -> Callable:
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, uid, set_a, set_b, text, sorted by the first: what connects each key's documents. A
        text that is not the set's, of a row that repeats an id, is passed over."""
        of = Shingler(words)
        for group in _groups(found, 1):
            ids, sets = [], []
            for uid, a, b, text in zip(*(group.column(k).to_pylist() for k in ("uid", "set_a", "set_b")), group.column("text"), strict=True):
                shingles = of(text.as_py())
                if fingerprint(shingles) == (a, b):
                    ids.append(uid)
                    sets.append(shingles)
            uids, first = np.unique(np.array(ids, np.int64), return_index=True)
            i, j = _links([sets[k] for k in first], percent)
            if len(i):
                yield _edges(*_classes(uids[i], uids[j]))

    return batches


def _compared(percent: int) -> Callable:
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, chunk, level, tree, uid, class, size, minor, large, tokens, sorted by the first two ->
        key, uid: the documents of each chunk with a candidate of another class that they have not met before."""
        for group in _groups(found, 2):
            level, tree, uid, cls, size, minor, large = (group.column(k).to_numpy() for k in ("level", "tree", "uid", "class", "size", "minor", "large"))
            chunk, few = group.column("chunk")[0].as_py(), np.flatnonzero(minor)
            many = np.arange(len(uid)) if chunk == 0 else np.flatnonzero(~minor)
            if not len(few) or not len(many):
                continue
            roots, tokens = _sketches(group.column("tokens").to_pylist())
            hit = np.zeros(len(uid), bool)
            step = max(1, 65_536 // len(many))
            # the earlier trees, or all of them below the roots, in which a pair may have been compared
            earlier = TREES if level[0] else int(tree[0])
            small = (large[:, None] >> np.arange(earlier) & 1) == 0
            for at in range(0, len(few), step):
                i, j = (x.ravel() for x in np.meshgrid(few[at : at + step], many, indexing="ij"))
                open_ = (cls[i] != cls[j]) & ((i < j) | ~minor[j])
                i, j = i[open_], j[open_]
                good = _passes(tokens, size, i, j, percent)
                i, j = i[good], j[good]
                met = ((roots[i, :earlier] == roots[j, :earlier]) & small[i]).any(1)
                i, j = i[~met], j[~met]
                hit[i], hit[j] = True, True
            if hit.any():
                ids = uid[hit]
                place = group.column("node").to_numpy()[:1].astype(np.uint64) + np.uint64(chunk) * np.uint64(0x9E3779B97F4A7C15)
                key = _mixed(place).astype(np.int64)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(ids)], names=["key", "uid"])

    return batches


def _spread(n, size):
    """Chunks that a node of ``n`` documents with ``size`` shingles is dealt to."""
    return F.greatest(F.ceil(n / CHUNK), F.ceil(size / BULK), F.lit(1))


def _confirm(docs: DataFrame, firsts: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links u, v that connect what links on full sets connect within each key of ``members`` (key, uid).
    ``docs`` has doc_id, text."""
    wanted = members.join(firsts.select("uid", "doc_id", "set_a", "set_b").hint("merge"), "uid")
    rows = docs.join(wanted.hint("merge"), "doc_id").select("key", "uid", "set_a", "set_b", "text")
    # by number: chunks are small but take time, so they are not to be merged into few tasks
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(mapped(rows.repartition(tasks, "key").sortWithinPartitions("key"), _confirmed(words, percent), "u long, v long"), "links")


def rooted(firsts: DataFrame) -> DataFrame:
    """tree, node, uid, size, hub, hub_size: the root nodes that several of ``firsts`` share."""
    root = lambda t: F.xxhash64(F.lit(t), F.substring("tokens", 8 * t + 1, 8))
    placed = firsts.select("uid", F.col("n_shingles").alias("size"), F.posexplode(F.array(*[root(t) for t in range(TREES)])).alias("tree", "node"))
    # stored, so that the join shuffles both sides and a hot node's rows can be split
    counted = placed.groupBy("node").agg(F.min(F.struct("uid", "size")).alias("hub"), F.max("uid").alias("last")).where("hub.uid < last")
    counted = stored(counted.select("node", F.col("hub.uid").alias("hub"), F.col("hub.size").alias("hub_size")), "shared")
    nodes = stored(placed.join(counted.hint("merge"), "node").select("tree", "node", "uid", "size", "hub", "hub_size"), "roots")
    release(counted)
    return nodes


def hub_links(docs: DataFrame, firsts: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links between documents and the hubs of their root nodes, and among those dealt to one hub's chunk."""

    def near(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            n = batch.num_rows
            tokens = _sketches(batch.column(4).to_pylist() + batch.column(5).to_pylist())[1] if n else np.zeros((0, COORDINATES), np.uint8)
            sizes = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            good = pa.array(_passes(tokens, sizes, np.arange(n), np.arange(n) + n, percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in range(3)], names=["hub", "uid", "size"])

    alike = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
    pairs = nodes.where((F.col("uid") != F.col("hub")) & alike).select("hub", "uid", "size", "hub_size").distinct()
    hubs = firsts.select(F.col("uid").alias("hub"), F.col("tokens").alias("hub_tokens"))
    pairs = pairs.join(firsts.select("uid", "tokens").hint("merge"), "uid").join(hubs.hint("merge"), "hub")
    pairs = stored(mapped(pairs.select("hub", "uid", "size", "hub_size", "tokens", "hub_tokens"), near, "hub long, uid long, size long"), "hub-pairs")
    sizes = stored(pairs.groupBy("hub").agg(_spread(F.count(F.lit(1)), F.sum("size")).alias("chunks")), "hub-sizes")
    key = F.xxhash64("hub", F.pmod(F.xxhash64("uid"), F.col("chunks")))
    dealt = pairs.join(sizes.hint("merge"), "hub").select(key.alias("key"), "hub", "uid")
    members = dealt.select("key", "uid").union(dealt.select("key", "hub").distinct())
    links = _confirm(docs, firsts, members, words, percent)
    release(pairs, sizes)
    return links


def _stated(placed: DataFrame, name: str) -> DataFrame:
    """node, chunks, top, minority of the nodes of ``placed`` (node, class, size) with several classes."""
    by_class = placed.groupBy("node", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    # the largest class, and the least of these
    of = by_class.groupBy("node").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", (-F.col("class")).alias("class"))).alias("top"), F.count(F.lit(1)).alias("classes"))
    of = of.where("classes > 1").select("node", _spread(F.col("n"), F.col("size")).alias("chunks"), (-F.col("top")["class"]).alias("top"), (F.col("n") - F.col("top")["n"]).alias("minority"))
    return stored(of, name)


def candidates(firsts: DataFrame, nodes: DataFrame, classes: DataFrame, percent: int, leaf: int = LEAF, done: int = DONE, levels: int = LEVELS) -> DataFrame:
    """key, uid: chunks of documents with candidates of another class. ``classes`` has uid, class of
    the documents that are linked so far."""
    known = stored(nodes.join(classes.hint("merge"), "uid", "left").select("tree", "node", "uid", "size", F.coalesce("class", "uid").alias("class")), "classed")
    of = _stated(known, "nodes0")
    large = F.col("minority") > leaf
    cols = ["level", "tree", "node", "uid", "class", "size", "chunks", "top", "minority", "large", "tokens"]
    opened = known.join(of.hint("merge"), "node").withColumn("bit", F.when(large, F.expr("shiftleft(1, tree)")).otherwise(0))
    by_uid = opened.groupBy("uid").agg(F.bit_or("bit").alias("large"))
    opened = opened.join(by_uid, "uid").join(firsts.select("uid", "tokens").hint("merge"), "uid")
    opened = stored(opened.withColumn("level", F.lit(0)).select(*cols), "open0", large=F.count_if(large & (F.bit_count("large") > done)))
    held, every = [known, of], [opened]
    below = opened.where(large & (F.bit_count("large") > done))
    level = 0
    while every[-1].observed["large"] and level < levels:
        level += 1
        at = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(COORDINATES))
        paths = [F.xxhash64("node", c, F.substring("tokens", (c + 8 * TREES + 1).cast("int"), F.lit(1))) for c in (at, F.pmod(at + COORDINATES // 2, F.lit(COORDINATES)))]
        both = F.pmod(F.xxhash64("node", F.lit(-level)), F.lit(2)) == 0
        placed = below.select("tree", "uid", "class", "size", "large", "tokens", F.explode(F.when(both, F.array(*paths)).otherwise(F.array(paths[0]))).alias("node"))
        of = _stated(placed, f"nodes{level}")
        opened = placed.join(of.hint("merge"), "node").withColumn("level", F.lit(level)).select(*cols)
        every.append(stored(opened, f"open{level}", large=F.count_if(large)))
        held.append(of)
        below = every[-1].where(large)
    rows = every[0].where(~large)
    for more in every[1:]:
        rows = rows.union(more.where(~large | (F.col("level") == levels)))
    minor = F.col("class") != F.col("top")
    own = F.pmod(F.xxhash64("uid"), F.col("chunks"))
    # what is outside the largest class goes to each chunk
    chunk = F.explode(F.when(minor, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(own)))
    rows = rows.select("node", chunk.alias("chunk"), "level", "tree", "uid", "class", "size", minor.alias("minor"), "large", "tokens")
    tasks = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = stored(mapped(rows.repartition(tasks, "node", "chunk").sortWithinPartitions("node", "chunk"), _compared(percent), "key long, uid long"), "candidates")
    release(*held, *every)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Sets are the distinct ``words``-word shingles; with fewer words the whole sequence is one.
    Null and empty texts have no shingles and are linked with nothing. Equal sets, so exact
    copies too, are one document to the join. Links are those with 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id reachable over them. Rows that repeat
    an id each return; if their texts differ, each follows the class of its own set. Rows with a null id are
    linked with nothing. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch() as keep:
        sets = keep(stored(mapped(own, _sketched(words), "doc_id long, n_shingles long, set_a long, set_b long, tokens binary"), "sets"))
        key = ["n_shingles", "set_a", "set_b"]
        firsts = sets.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
        firsts = stored(firsts.withColumn("uid", F.monotonically_increasing_id()), "firsts")
        nodes = rooted(firsts)
        links = hub_links(own, firsts, nodes, words, percent)
        found = components(links)
        more = candidates(firsts, nodes, found.select(F.col("node").alias("uid"), F.col("root").alias("class")), percent)
        links = links.union(_confirm(own, firsts, more, words, percent))
        roots = components(links).select(F.col("node").alias("uid"), "root").join(firsts.select("uid", "doc_id", *key).hint("merge"), "uid")
        least = roots.groupBy("root").agg(F.min("doc_id").alias("component"))
        linked = roots.join(least, "root").select("uid", "component")
        classes = firsts.select("uid", "doc_id", *key).join(linked.hint("merge"), "uid", "left").select(*key, F.coalesce("component", "doc_id").alias("component"))
        classes = keep(stored(classes, "classes"))  # so that the rows of a set of many copies can be split
    out = sets.select("doc_id", *key).join(classes.hint("merge"), key, "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, with all its columns.

    Null ids come after all others; of null ids with one text one row stays. Texts without words
    stay. Rows that repeat an id stay together. Columns may have any names.
    """
    lone = F.coalesce(F.col(id_col).isNull() & F.col(text_col).rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    id_, digest, stay = (unused(docs, x) for x in ("__id", "__digest", "__stay"))
    with scratch() as hold:
        if docs.where(lone).isEmpty():
            keep = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_))
            keep = hold(stored(keep, "kept"))
            return docs.join(keep.hint("merge"), F.col(id_col).eqNullSafe(F.col(id_)), "left_semi").select(*docs.columns)
        most = docs.agg(F.max(F.col(id_col).cast("long"))).first()[0]
        keys = docs.where(lone).select(F.sha2(text_col, 256).alias(digest)).distinct()
        keys = hold(stored(keys.withColumn(id_, F.monotonically_increasing_id() + F.lit(0 if most is None else most + 1)), "keys"))
        named = docs.where(lone).join(keys.hint("merge"), F.sha2(text_col, 256) == F.col(digest))
        known = docs.where(F.col(id_col).isNotNull())
        own = known.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        own = own.unionByName(named.select(F.col(id_).alias("doc_id"), F.col(text_col).alias("text")))
        keep = hold(stored(near_duplicates(own).where("kept").select(F.col("doc_id").alias(stay)).distinct(), "kept"))
    known = known.join(keep.hint("merge"), F.col(id_col) == F.col(stay), "left_semi").select(*docs.columns)
    named = named.join(keep.hint("merge"), F.col(id_) == F.col(stay), "left_semi").dropDuplicates([id_]).select(*docs.columns)
    return known.unionByName(named).unionByName(docs.where(F.col(id_col).isNull() & ~lone))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_in FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_in >= 80 * (p.n + q.n - both_in)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.seen)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
