"""Sessions, and a SQL facade that runs queries only."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import EngineError, InvalidInput, PermissionDenied, Storage

#: Seconds after which a query's jobs are cancelled.
TIMEOUT_S = 30.0


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, adaptive plans, Arrow."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Engine:
    """Queries over named relations. DDL, DML and other commands are refused before they run.

    A table function whose columns depend on its arguments (``functions``: name to a function of literals that
    gives a DataFrame) can stand wherever a relation can: ``SELECT * FROM fs('/a/*.csv')``.
    """

    def __init__(self, spark: SparkSession, relations: Mapping[str, DataFrame] | None = None, read_only: bool = True, functions: Mapping[str, Callable[..., DataFrame]] | None = None):
        self.spark, self.read_only = spark, read_only
        self.functions = {k.lower(): f for k, f in (functions or {}).items()}
        self.relations: dict[str, DataFrame] = {}
        for name, df in (relations or {}).items():
            self.register(name, df)

    def register(self, name: str, df: DataFrame) -> None:
        if not name.isidentifier():
            raise InvalidInput(f"relation name: {name!r}")
        self.relations[name] = df
        df.createOrReplaceTempView(name)

    def require_writable(self) -> None:
        if self.read_only:
            raise PermissionDenied("the session is read-only")

    def check(self, text: str):
        """The parsed plan; raises unless ``text`` is one query."""
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Exception as e:
            raise InvalidInput(str(e).split("\n", 1)[0]) from e
        if is_command(plan):
            raise PermissionDenied("only queries are allowed")
        return plan

    def _with_functions(self, text: str, plan) -> str:
        """``text`` with the calls of ``functions``, as the parser found them, replaced by views."""
        calls = {}  # by place, for a named query is found more than once
        for node in nodes(plan):
            if node.getClass().getSimpleName() == "UnresolvedTableValuedFunction" and (name := node.name().mkString(".").lower()) in self.functions:
                args = [_literal(node.functionArgs().apply(k), name) for k in range(node.functionArgs().size())]
                origin = node.origin()
                calls[origin.startIndex().get()] = (origin.stopIndex().get(), name, args)
        for start, (stop, name, args) in sorted(calls.items(), reverse=True):
            try:
                found = self.functions[name](*args)
            except TypeError as e:
                raise InvalidInput(f"{name}: {e}") from e
            view = f"__{name}_{uuid.uuid4().hex}"
            found.createOrReplaceTempView(view)
            # what the parser took for the call ends at its bracket or at its alias
            call = text[start : stop + 1]
            text = text[:start] + view + call[_closing(call) + 1 :] + text[stop + 1 :]
        return text

    def sql(self, text: str) -> DataFrame:
        plan = self.check(text)
        try:
            return self.spark.sql(self._with_functions(text, plan) if self.functions else text)
        except Exception as e:
            raise classified(e) from e

    def rows(self, text: str, timeout_s: float = TIMEOUT_S) -> list[str]:
        """The result as JSON objects, one a row; jobs still running after ``timeout_s`` are cancelled."""
        df = self.sql(text)
        group, sc = uuid.uuid4().hex, self.spark.sparkContext
        timer = threading.Timer(timeout_s, sc.cancelJobGroup, [group])
        sc.setJobGroup(group, text[:80], interruptOnCancel=True)
        timer.start()
        try:
            return [r[0] for r in df.selectExpr("to_json(struct(*)) AS row").collect()]
        except Exception as e:
            raise classified(e) from e
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)


def nodes(plan):
    """A parsed plan's nodes, those of subqueries and of named queries too."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        found = [node.children(), node.innerChildren()]
        try:
            found.append(node.expressions())
        except Exception:  # an expression has none
            pass
        for some in found:
            todo += [x for x in (some.apply(k) for k in range(some.size())) if "catalyst" in x.getClass().getName()]
        try:
            todo.append(node.plan())
        except Exception:  # only subqueries have a plan
            pass


def _literal(expression, name: str):
    """The value of a literal argument; null and anything else are errors."""
    if expression.getClass().getSimpleName() != "Literal" or expression.value() is None:
        raise InvalidInput(f"{name}: arguments are literals")
    value = expression.value()
    return value if isinstance(value, (int, float, bool)) else value.toString()


def _closing(call: str) -> int:
    """Where the bracket that opens first is closed; brackets in quotes do not count."""
    depth, quote = 0, ""
    for k, c in enumerate(call):
        if quote:
            quote = "" if c == quote and call[k - 1] != "\\" else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return k
    raise InvalidInput("a call without its end")


def is_command(plan) -> bool:
    """Whether a parsed plan, or a part of it, does anything but read."""
    name = plan.getClass().getName()
    simple = name.rsplit(".", 1)[-1]
    if ".command." in name or "Command" in simple or simple.startswith(("Create", "Drop", "Alter", "Insert", "Update", "Delete", "Merge", "Replace", "Set", "Cache", "Uncache", "Truncate", "Load", "Repair", "Refresh", "Analyze", "Show", "Describe", "Explain", "Use", "Comment", "Add", "Rename")):
        return not simple.startswith("SetOperation")
    kids = plan.children()
    return any(is_command(kids.apply(k)) for k in range(kids.size()))


def classified(error: Exception) -> EngineError:
    """The error class that tells whose fault it is."""
    name, first = type(error).__name__, str(error).split("\n", 1)[0]
    if isinstance(error, EngineError):
        return error
    return InvalidInput(first) if name in ("AnalysisException", "ParseException", "NumberFormatException", "SparkRuntimeException") else Storage(first)
