"""Queries against their SQL on a table of odd texts: empty, blank, null, of odd spaces, beyond the block."""

from __future__ import annotations

import os

import pytest

from corpuskit.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import TABLES, compare

TEXTS = ["", " ", "\t", "  a ", "\n x \n", "　", "​q​", "é😀é", "a" * 7999 + " ", "\x1f y \x85", None, "\xa0 z", "   q\r\n", "abc😀😀defg" * 5, "x" * 2047, "x" * 2048, "x" * 2049, " z ", "﻿b"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    # Twelve ids for each text, so that it meets every branch by id.
    rows = [(i + j * len(TEXTS), t, "en", f"src{j}", len(t or "")) for j in range(12) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    for name in set(TABLES) - {"documents"}:
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["filled_in_middle", "masked_labels", "scan_prose", "scan_code"])
def test_odd_texts_give_the_rows_of_the_sql(spark, odd, name):
    assert compare(spark, odd, QUERIES[name], ORACLE_SQL[name]) > 0
