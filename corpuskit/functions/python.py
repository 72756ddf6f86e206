"""What needs a Python parser: syntax checks and the shape of code, as Arrow-batched functions."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

_ERASED = {ast.Name: ("id", "_"), ast.FunctionDef: ("name", "_"), ast.AsyncFunctionDef: ("name", "_"), ast.ClassDef: ("name", "_"), ast.arg: ("arg", "_"), ast.Constant: ("value", 0), ast.Attribute: ("attr", "_")}


def tree_of(code: str | None) -> ast.AST | None:
    if code is None:
        return None
    with warnings.catch_warnings():
        warnings.filterwarnings("ignore", category=SyntaxWarning)
        try:
            return ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


def shape_of(code: str | None) -> str | None:
    """The syntax tree with names and constants erased; null if there is none."""
    tree = tree_of(code)
    if tree is None:
        return None
    for node in ast.walk(tree):
        if (erased := _ERASED.get(type(node))) is not None:
            setattr(node, *erased)
    try:
        found: str | None = ast.dump(tree, False)
    except RecursionError:
        found = None
    return found


@F.pandas_udf(BooleanType())
def parses(code: pd.Series) -> pd.Series:
    return code.map(lambda c: tree_of(c) is not None).astype(bool)


@F.pandas_udf(StringType())
def shape(code: pd.Series) -> pd.Series:
    return code.map(shape_of)
