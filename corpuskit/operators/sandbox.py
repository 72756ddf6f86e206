"""Runs candidate code against tests, one process each. Off unless asked for by name: the code isn't trusted."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpuskit.functions.python import tree_of

#: Run in the child before the candidate: bounds of memory, CPU time and depth.
_LIMITS = "import resource as r, sys\nfor what, most in ((r.RLIMIT_AS, {memory}), (r.RLIMIT_CPU, {cpu})):\n    r.setrlimit(what, (most, most))\nsys.setrecursionlimit(2000)\n"


def _classified(stderr: str) -> tuple[str, str]:
    kept = [x.strip() for x in stderr.splitlines() if x.strip()]
    detail = kept[-1] if kept else ""
    name = detail.partition(":")[0].strip()
    table = {"AssertionError": "FAIL", "NameError": "NAME_ERROR"} | dict.fromkeys(("SyntaxError", "IndentationError", "TabError"), "SYNTAX_ERROR")
    return table.get(name, "ERROR"), detail


def run_one(code: str, tests: str, setup: str = "", timeout: int = 10, memory: int = 1 << 30) -> tuple[str, str]:
    """(outcome, detail). The tests have passed only if the line after them was reached, so that leaving early is no pass."""
    if tree_of(code) is None:
        return "SYNTAX_ERROR", "does not parse"
    mark = uuid.uuid4().hex
    program = "\n".join([_LIMITS.format(memory=memory, cpu=timeout + 1), setup, code, tests, f"print({mark!r})"])
    with tempfile.TemporaryDirectory() as folder:
        try:
            done = subprocess.run([sys.executable, "-I", "-c", program], cwd=folder, env={"PATH": os.defpath}, capture_output=True, text=True, timeout=timeout, stdin=subprocess.DEVNULL)
        except subprocess.TimeoutExpired:
            return "TIMEOUT", f"over {timeout} s"
    if done.returncode == 0:
        return ("PASS", "") if mark in done.stdout else ("ERROR", "ended before its tests")
    return _classified(done.stderr)


def run_candidates(candidates: DataFrame, allow_untrusted_code: bool = False, timeout: int = 10) -> DataFrame:
    """(task_id, sample, outcome, detail, parses, code) of candidates (task_id, sample, code, test_code, setup_code)."""
    if not allow_untrusted_code:
        raise PermissionError("this runs untrusted code; pass allow_untrusted_code=True if the workers are isolated")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [run_one(c, t, s or "", timeout) for c, t, s in zip(b["code"], b["test_code"], b["setup_code"], strict=True)]
            yield pd.DataFrame({"task_id": b["task_id"], "sample": b["sample"], "outcome": [o for o, _ in found], "detail": [d for _, d in found], "parses": [tree_of(c) is not None for c in b["code"]], "code": b["code"]})

    return candidates.select("task_id", "sample", "code", "test_code", "setup_code").mapInPandas(run, "task_id string, sample int, outcome string, detail string, parses boolean, code string")
