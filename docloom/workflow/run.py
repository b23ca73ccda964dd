"""Workflows in TOML as graphs of lazy DataFrames.

A step is a function from its dependencies' union to a DataFrame; nothing runs before a step writes or the caller acts on a
result, so Catalyst sees a whole branch at once.  There is no scheduler of our own.
"""

from __future__ import annotations

import re
import tomllib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import Aggregate, by_table_function, grouped
from ..operators.sql import run_sql
from ..sinks import tables
from ..sources.providers import embedded, hashed_vectors, prompted

STEP_TYPES = {"sql", "function", "table-function", "aggregate", "write-db", "embed", "llm", "table"}
ALIASES = {"write": "write-db", "batch-llm": "llm", "batch-embedding": "embed"}
_KEYS = {"workflow", "inputs", "steps"}
_STEP_KEYS = {"type", "depends_on", "config", "function", "continue_on_error"}
_TYPES = {"string": str, "int": int, "float": (float, int), "bool": bool}
#: Fixed value: the syntax of a slot in a step's settings.
_SLOT = re.compile(r"(?<!\\)\{\{\s*(\w+)(?::(string|int|float|bool))?\s*\}\}")


class WorkflowError(ValueError):
    pass


@dataclass
class Step:
    name: str
    type: str
    depends_on: list[str] = field(default_factory=list)
    config: dict[str, Any] = field(default_factory=dict)
    function: str | None = None
    continue_on_error: bool = False


@dataclass
class Workflow:
    name: str
    inputs: dict[str, dict]
    steps: dict[str, Step]
    order: list[str]


def parse(text: str) -> Workflow:
    """Strict: unknown keys, step types and dependencies, mistyped defaults and cycles are errors."""
    raw = tomllib.loads(text)
    if extra := set(raw) - _KEYS:
        raise WorkflowError(f"Unknown keys: {sorted(extra)}")
    steps = {}
    for name, s in raw.get("steps", {}).items():
        if extra := set(s) - _STEP_KEYS:
            raise WorkflowError(f"Unknown keys in step {name}: {sorted(extra)}")
        kind = ALIASES.get(s.get("type", ""), s.get("type", ""))
        if kind not in STEP_TYPES:
            raise WorkflowError(f"Unknown type of step {name}: {kind!r}")
        steps[name] = Step(name, kind, s.get("depends_on", []), s.get("config", {}), s.get("function"), s.get("continue_on_error", False))
    for s in steps.values():
        if missing := [d for d in s.depends_on if d not in steps]:
            raise WorkflowError(f"Unknown dependencies of step {s.name}: {missing}")
    inputs = raw.get("inputs", {})
    for name, i in inputs.items():
        if i.get("type", "string") not in _TYPES:
            raise WorkflowError(f"Unknown type of input {name}")
        if "default" in i and not isinstance(i["default"], _TYPES[i.get("type", "string")]):
            raise WorkflowError(f"The default of input {name} is no {i['type']}")
    try:
        order = [n for level in levels(steps) for n in level]
    except CycleError as e:
        raise WorkflowError(f"Cycle: {' -> '.join(e.args[1])}") from e
    return Workflow(raw.get("workflow", {}).get("name", ""), inputs, steps, order)


def levels(steps: dict[str, Step]) -> list[list[str]]:
    """Steps by the length of the longest chain before them; in a level by priority (setting ``priority``, 100 without one) and name."""
    depth: dict[str, int] = {}
    for name in TopologicalSorter({n: s.depends_on for n, s in steps.items()}).static_order():
        depth[name] = 1 + max((depth[d] for d in steps[name].depends_on), default=-1)
    ordered = sorted(steps, key=lambda n: (depth[n], steps[n].config.get("priority", 100), n))
    return [list(group) for _, group in groupby(ordered, key=depth.__getitem__)]


def critical_path(steps: dict[str, Step]) -> list[str]:
    """The longest chain of steps from start to end; of equal ones the one whose last steps come first by priority and name."""
    rank = lambda n: (-len(chain[n]), steps[n].config.get("priority", 100), n)
    chain: dict[str, list[str]] = {}
    for name in (n for level in levels(steps) for n in level):
        before = min(steps[name].depends_on, key=rank, default=None)
        chain[name] = [*(chain[before] if before else []), name]
    return chain[min(chain, key=rank)] if chain else []


def bound(workflow: Workflow, given: dict[str, Any]) -> dict[str, Any]:
    """Inputs with defaults; a required one that is missing is an error, others than declared stay."""
    out = {n: i["default"] for n, i in workflow.inputs.items() if "default" in i} | given
    if missing := [n for n, i in workflow.inputs.items() if i.get("required") and n not in out]:
        raise WorkflowError(f"Missing inputs: {missing}")
    return out


def _typed(value: Any, kind: str | None) -> Any:
    if kind == "bool" and isinstance(value, str):
        if value.lower() not in ("true", "1", "yes", "false", "0", "no"):
            raise WorkflowError(f"{value!r} is no bool")
        return value.lower() in ("true", "1", "yes")
    return {"int": int, "float": float, "string": str, "bool": bool, None: lambda x: x}[kind](value)


def filled(value: Any, inputs: dict[str, Any]) -> Any:
    """Templates replaced, in nested values too; a text that is one slot keeps the value's type; ``\\{{`` stays as text."""
    if isinstance(value, dict):
        return {k: filled(v, inputs) for k, v in value.items()}
    if isinstance(value, list):
        return [filled(v, inputs) for v in value]
    if not isinstance(value, str):
        return value

    def one(m):
        if m[1] not in inputs:
            raise WorkflowError(f"Unknown input {m[1]!r}")
        return _typed(inputs[m[1]], m[2])

    whole = _SLOT.fullmatch(value)
    return one(whole) if whole else _SLOT.sub(lambda m: str(one(m)), value).replace("\\{{", "{{")


def as_named(query: str) -> str:
    """Slots in SQL become named parameters, so that values never become text of the query."""
    return _SLOT.sub(lambda m: f":{m[1]}", query)


def fan_in(frames: list[DataFrame]) -> DataFrame:
    """All rows of all inputs, repeats kept, columns by name, and ``_src`` for the order of the inputs."""
    out = None
    for k, df in enumerate(frames):
        df = df.drop("_src").withColumn("_src", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def run(spark: SparkSession, workflow: Workflow, inputs: dict[str, Any], sources: dict[str, DataFrame], functions: dict[str, Callable | Aggregate] | None = None, folder: str | None = None, providers: dict | None = None) -> dict[str, DataFrame]:
    """The steps' frames.  ``sources`` are the tables that SQL sees; write steps commit versions below ``folder``.

    ``functions`` holds what steps name: a ``function`` step takes a callable from its rows and settings to a frame, a ``table-function`` step a
    ``udtf`` (settings ``partition_by``, ``order_by`` with ``-`` for descending, ``params``), an ``aggregate`` step an ``Aggregate`` (``group_by``).

    A failing step ends the run, unless it may be continued past: then its dependents get no rows from it.  So that a failure shows there
    and not when a dependent runs, such a step's rows are stored below ``folder`` (without one, checkpointed) before the next step is made.
    """
    values, out, sources = bound(workflow, inputs), {}, dict(sources)
    for name in workflow.order:
        step = workflow.steps[name]
        parents = [out[d].drop("_src") for d in step.depends_on if d in out]
        rows = (parents[0] if len(parents) == 1 else fan_in(parents)) if parents else None
        if rows is None and values:
            rows = spark.createDataFrame([values])
        try:
            made = _frame(spark, step, rows, values, sources, functions or {}, folder, providers or {})
            out[name] = _kept(made, folder, name) if step.continue_on_error else made
        except Exception:
            if not step.continue_on_error:
                raise
    return out


def _kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    if not folder:
        return df.checkpoint()
    path = f"{folder}/_steps/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _names(config: dict[str, Any], key: str) -> list[str]:
    found = config.get(key, [])
    return [found] if isinstance(found, str) else found


def _frame(spark, step: Step, rows, values, sources, functions, folder, providers) -> DataFrame:
    c = step.config
    if step.type == "sql":
        params = {k: v for k, v in values.items()} | filled(c.get("params", {}), values)
        return run_sql(spark, as_named(c["query"]), params, sources)
    if step.type == "table":
        return sources[filled(c["name"], values)]
    if step.type == "function":
        return functions[step.function](rows, filled(c, values))
    if step.type == "table-function":
        c = filled(c, values)
        return by_table_function(rows, functions[step.function], _names(c, "partition_by"), _names(c, "order_by"), c.get("params"))
    if step.type == "aggregate":
        return grouped(rows, _names(filled(c, values), "group_by"), functions[step.function])
    if step.type == "embed":
        return embedded(rows, c.get("text_field", "text"), c.get("max_chars", 8000), c.get("batch_size", 100), providers.get("embed", hashed_vectors))
    if step.type == "llm":
        return prompted(rows, c["prompt_template"], providers["llm"], c.get("batch_size", 100))
    c = filled(c, values)
    keys = _names(c, "key")
    rows, target = tables.encoded(rows), sources.get(c["table"])
    if target is None:
        target = spark.createDataFrame([], rows.schema)
    found = tables.statuses(target, rows, keys) if keys else rows.withColumn("write_status", F.lit("inserted"))
    new = {"insert": lambda: tables.inserted(target, rows), "upsert": lambda: tables.upserted(target, rows, keys), "replace": lambda: tables.replaced(target, rows, keys)}[c.get("mode", "insert")]()
    sources[c["table"]] = spark.read.parquet(tables.commit(new, f"{folder}/{c['table']}"))
    return found
