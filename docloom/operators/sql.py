"""Guarded SQL: SELECT only, named parameters, named errors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"(?<!:):([A-Za-z_]\w*)")
#: A table of another schema, or a file, after FROM, JOIN or a comma between tables.
_QUALIFIED = re.compile(r"(?i)\b(?:from|join)\s+(?:[\w`]+\s*(?:as\s+)?\w*\s*,\s*)*[\w`]+\s*\.|\.\s*`[^`]*/")


@dataclass
class SqlError(Exception):
    """``kind`` is parameter_error, not_select, table_not_found, syntax_error or query_error, or tenant_error."""

    kind: str
    message: str
    details: dict = field(default_factory=dict)


def parameters(text: str) -> list[str]:
    """Names after a single colon, in order, also inside literals; ``::type`` isn't one."""
    return list(dict.fromkeys(_NAME.findall(text)))


def positional(text: str, params: dict) -> tuple[str, list]:
    """The text with ``?`` for names, and the values in order."""
    values = [params[n] for n in _NAME.findall(text)]
    return _NAME.sub("?", text), values


def table_exists(spark: SparkSession, name: str, tables: dict[str, DataFrame] | None = None) -> bool:
    """Whether a statement could name the table: one of ``tables``, a view or a table of the catalog; a name that is none at all isn't there."""
    try:
        return name in (tables or {}) or spark.catalog.tableExists(name)
    except (ParseException, AnalysisException):
        return False


def of_tenant(tables: dict[str, DataFrame], column: str, tenant: object, shared: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """``tables`` with one tenant's rows only; a table without the tenant's column is refused, unless it is ``shared``.

    A null tenant sees no rows.  The filter is part of each view, so it holds in joins, subqueries and unions alike, and is pushed down
    to the scan.
    """
    if bare := sorted(n for n, df in tables.items() if column not in df.columns and n not in shared):
        raise SqlError("tenant_error", f"Tables without {column}: {', '.join(bare)}", {"tables": bare})
    return {n: df.where(F.col(column) == F.lit(tenant)) if column in df.columns else df for n, df in tables.items()}


def run_sql(spark: SparkSession, text: str, params: dict | None = None, tables: dict[str, DataFrame] | None = None, tenant: tuple[str, object] | None = None, shared: tuple[str, ...] = ()) -> DataFrame:
    """A lazy frame for a SELECT over ``tables``, with parameters bound as values and never spliced into the text.

    ``tenant`` is a column and a value: every table then stands for that tenant's rows, wherever the statement names it, and
    other tables of the session, qualified names and files are refused.
    """
    if tenant:
        tables = of_tenant(tables or {}, *tenant, shared)
        others = {t.name.lower() for t in spark.catalog.listTables()} - {n.lower() for n in tables}
        named = others & {w.lower() for w in re.findall(r"\w+", text)}
        if named or _QUALIFIED.search(text):
            raise SqlError("tenant_error", "Only the given tables may be named", {"tables": sorted(named)})
    params = params or {}
    words = text.split(None, 1)
    if not words or words[0].upper() != "SELECT":
        raise SqlError("not_select", "Only SELECT queries are allowed")
    missing = sorted(set(parameters(text)) - set(params))
    if missing:
        raise SqlError("parameter_error", f"Missing parameters: {', '.join(missing)}", {"missing": missing})
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args={k: v for k, v in params.items() if k in parameters(text)})
    except ParseException as e:
        raise SqlError("syntax_error", str(e)) from e
    except AnalysisException as e:
        raise SqlError("table_not_found" if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND" else "query_error", str(e)) from e
    except PySparkException as e:
        raise SqlError("query_error", str(e)) from e
