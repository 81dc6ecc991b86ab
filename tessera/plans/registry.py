"""The registry of queries and of the SQL that states their results."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import Conflict
from tessera.intermediate import file_system, shared_dir
from tessera.operators import segments, vector_index
from tessera.operators.segments import SegmentIndex
from tessera.operators.vector_index import VectorIndex
from tessera.session import Engine
from tessera.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _digest(*x: str) -> str:
    return hashlib.sha256("\n".join(x).encode()).hexdigest()[:24]


class Source:
    """Relations by name: ``r("files_meta")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return fixtures.relation(self.spark, self.sf_dir, name)

    def _mark(self, *tables: str) -> str:
        """Stands for the files of ``tables`` as they now are."""
        marks = []
        for t in tables:
            system, path = file_system(self.spark, f"{self.sf_dir}/{t}.parquet")
            found = system.getFileStatus(path)
            files = [found] if found.isFile() else list(system.listStatus(path))
            marks += [f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in files]
        return _digest(*sorted(marks))

    def _folder(self, name: str, *settings: str) -> str:
        return f"{shared_dir(self.spark)}/tessera/{name}-{_digest(self.sf_dir, *settings)}"

    def vector_index(self, name: str, rows: DataFrame, *tables: str) -> VectorIndex:
        """The stored index of ``rows`` (id, vector), built where there is none of these files as they now are."""
        folder, mark = self._folder("vectors-" + name), self._mark(*tables)
        found = vector_index.opened(self.spark, folder)
        if found is not None and found.snapshot.properties["watermark"] == mark:
            return found
        try:
            return vector_index.build(rows, folder, watermark=mark)
        except Conflict:
            return vector_index.opened(self.spark, folder)

    def text_index(self, name: str, docs: DataFrame, *tables: str, keep: tuple[str, ...] = (), tokeniser: str = "words") -> SegmentIndex:
        """The stored index of ``docs`` (id, content and what to ``keep``), which come of ``tables``: brought
        to these files as they now are, where they changed. Of two sessions at once one waits for the other's."""
        folder = self._folder("index-" + name, tokeniser, str(segments.text.TOKENISERS[tokeniser]), str(segments.BLOCK), str(segments.FORMAT), *keep)
        mark = self._mark(*tables)
        for last in (False, False, True):
            try:
                return segments.sync(self.spark, folder, docs, mark, keep=keep, tokeniser=tokeniser)
            except Conflict:
                if last:
                    raise


def query(name: str, oracle: str | None = None, *names: str):
    """Registers a function of a ``Source``; ``oracle`` is DuckDB's SQL over the relations ``names``."""

    def put(f: Callable[[Source], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = fixtures.duck(oracle, *names)
        return f

    return put


#: Bytes of a driver table's files for each task that it is dealt to.
DEALT = 8 << 20


def _dealt(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    """A driver table with all rows of a value of ``column`` in one task."""
    system, path = file_system(spark, f"{sf_dir}/{name}.parquet")
    return fixtures.table(spark, sf_dir, name).repartition(system.getContentSummary(path).getLength() // DEALT + 1, column)


def sql(name: str, text: str, oracle: str | None = None, dealt: dict[str, str] | None = None) -> None:
    """Registers a query of the SQL facade; ``oracle`` where DuckDB spells it another way. Tables in ``dealt`` are
    shuffled by that column first, so that groups by it and more are made without another shuffle."""
    words = set(re.findall(r"[a-z_]+", text))
    own = [n for n in (*fixtures.TABLES, *fixtures.RELATIONS) if n in words]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {n: fixtures.relation(spark, sf_dir, n) for n in own} | {n: _dealt(spark, sf_dir, n, c) for n, c in (dealt or {}).items()}
        return Engine(spark, frames).sql(text)

    assert name not in QUERIES, name
    QUERIES[name] = run
    ORACLES[name] = fixtures.duck(oracle or text, *[n for n in own if n in fixtures.RELATIONS])
