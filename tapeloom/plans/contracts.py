"""What each analyzer needs and gives, taken from its plan; and what Python sources ask of a table, taken from their text."""

from __future__ import annotations

import ast
import hashlib
import inspect
import json
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tapeloom.functions.sheet import Sheet
from tapeloom.operators.base import BAR

from . import analyzers
from .features import build


@dataclass(frozen=True)
class Contract:
    analyzer: str
    features: list[str]
    outputs: list[str]
    votes: list[str]
    sha256: str


def contracts() -> dict[str, Contract]:
    known = {**BAR, **build(Sheet(dict(BAR)))}
    out = {}
    for name, make in analyzers.ANALYZERS.items():
        s = Sheet(dict.fromkeys(known, "double"))
        columns, votes = make(s)
        out[name] = Contract(name, analyzers.required(name), list(columns), sorted(votes), hashlib.sha256(inspect.getsource(make).encode()).hexdigest())
    return out


def export(path: str) -> None:
    Path(path).write_text(json.dumps({k: asdict(v) for k, v in contracts().items()}, indent=1))


def problems(found: dict[str, Contract], columns: list[str]) -> dict[str, list[str]]:
    """For each analyzer the features that a table with these columns lacks."""
    return {k: gone for k, c in found.items() if (gone := [f for f in c.features if f not in columns])}


def table(spark: SparkSession) -> DataFrame:
    """(analyzer, features, outputs, votes, sha256)."""
    return spark.createDataFrame([tuple(asdict(c).values()) for c in contracts().values()], "analyzer string, features array<string>, outputs array<string>, votes array<string>, sha256 string")


def scan(source: str) -> dict[str, list[str]]:
    """Column names that a source subscripts or gets by name, functions it calls and modules it imports."""
    columns, calls, modules = set(), set(), set()
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            columns.add(node.slice.value)
        elif isinstance(node, ast.Call):
            f = node.func
            calls.add(f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", ""))
            if isinstance(f, ast.Attribute) and f.attr in ("get", "col") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
                columns.add(node.args[0].value)
        elif isinstance(node, ast.Import):
            modules |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            modules.add(node.module or "")
    return {"columns": sorted(columns), "calls": sorted(calls - {""}), "modules": sorted(modules)}
