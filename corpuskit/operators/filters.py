"""Predicates and the instruction cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.config import PROSE_AUDIENCES_OUT, PROSE_FORMATS, PYTHON_TAGS, Gates
from corpuskit.functions import text as T
from corpuskit.functions.python import parses


def under_cap(text: Column, cap: int | Column, inclusive: bool = False) -> Column:
    """Whether the text, as it is before stripping, is short enough; the corpus caps are strict, the instruction cap isn't. Null isn't."""
    n = F.length(text)
    return F.coalesce(n <= cap if inclusive else n < cap, F.lit(False))


def is_python(language: Column, versions: bool = False) -> Column:
    return F.coalesce(F.lower(language).isin("python", "python3") if versions else F.lower(language) == "python", F.lit(False))


def prose_wanted(audience: Column, kind: Column) -> Column:
    return F.coalesce(~F.lower(audience).isin(*PROSE_AUDIENCES_OUT) & F.lower(kind).isin(*PROSE_FORMATS), F.lit(False))


def with_gate(rows: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """rows (source, ord, prompt, response) with task, code and the first gate of the text that they fail, as drop_reason.

    The syntax check is not among these, so that no Python runs on rows that are out already; see with_syntax().
    """
    blocks = T.fenced_blocks(F.col("response"))
    out = rows.withColumn("task", T.strip(F.col("prompt"))).withColumn("blocks", blocks)
    out = out.withColumn("code", F.trim(F.get("blocks", F.lit(0))["body"], F.lit("\n"))).withColumn("tag", F.get("blocks", F.lit(0))["lang"])
    n, m = F.length("task"), F.length("code")
    reason = (
        F.when(F.coalesce(F.col("task"), F.lit("")) == "", "empty").when(F.coalesce(T.strip(F.col("response")), F.lit("")) == "", "empty")
        .when(~n.between(*gates.prompt), "prompt_length")
        .when(T.conceptual(F.col("task")) | ~T.asks_code(F.col("task")), "not_a_code_request")
        .when(F.size("blocks") == 0, "no_fenced_block")
        .when(F.size("blocks") > 1, "multi_block")
        .when(~F.col("tag").isin(*PYTHON_TAGS), "not_python")
        .when(~m.between(*gates.code), "code_length")
        .when(n + m > gates.pair, "pair_too_long")
    )
    return out.withColumn("drop_reason", reason).drop("blocks", "tag")


def with_syntax(gated: DataFrame) -> DataFrame:
    """Rows that failed no gate so far get "unparseable" if their code is; the parser sees no others."""
    passed = gated.where("drop_reason is null").withColumn("drop_reason", F.when(~parses(F.col("code")), "unparseable"))
    return gated.where("drop_reason is not null").unionByName(passed)


def fits(ids: Column, block: int) -> Column:
    return F.size(ids) <= block


def pair_fits(chosen: Column, rejected: Column, block: int) -> Column:
    return F.greatest(F.size(chosen), F.size(rejected)) <= block
