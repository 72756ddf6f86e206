"""Sample groups and what is derived from their outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.functions.python import parses
from corpuskit.operators.dedup import checkpointed
from corpuskit.operators.mix import numbered


def groups(records: DataFrame) -> DataFrame:
    """(task_id, prompt, samples: array of (code, outcome) in order of sample) of flat records."""
    held = F.array_sort(F.collect_list(F.struct("sample", "code", "outcome")))
    return records.groupBy("task_id", "prompt").agg(F.transform(held, lambda s: F.struct(s["code"].alias("code"), s["outcome"].alias("outcome"))).alias("samples"))


def flat(grouped: DataFrame) -> DataFrame:
    return grouped.select("task_id", "prompt", F.posexplode("samples").alias("sample", "s")).select("task_id", "prompt", "sample", "s.code", "s.outcome")


def passing(records: DataFrame) -> DataFrame:
    """(task_id, prompt, completion) of passing samples, each task's stripped code once, its first form kept as it is."""
    good = records.where("outcome = 'PASS'").withColumn("__code", T.strip(F.col("code")))
    rn = F.row_number().over(Window.partitionBy("task_id", "__code").orderBy("sample"))
    return good.withColumn("__rn", rn).where("__rn = 1").select("task_id", "sample", "prompt", T.fenced_python(F.col("code")).alias("completion"))


def pairs(records: DataFrame) -> DataFrame:
    """(task_id, prompt, chosen, rejected) of tasks with both outcomes: the shortest passing sample, and the other nearest to it in length; the first on a tie."""
    out = chosen_pairs(records.withColumn("__size", F.length("code")), "code", "__size")
    return out.select("task_id", "prompt", T.fenced_python(F.col("good")).alias("chosen"), T.fenced_python(F.col("bad")).alias("rejected"))


def chosen_pairs(records: DataFrame, code: str, size: str) -> DataFrame:
    """(task_id, prompt, good, bad) of the same pairs as the column `code` has them, by the column `size`; `code` may be the code's key, so that no code is moved."""
    chosen = records.where("outcome = 'PASS'").groupBy("task_id", "prompt").agg(F.min_by(F.struct(code, size), F.struct(size, "sample")).alias("good"))
    both = records.where("outcome <> 'PASS'").join(chosen, ["task_id", "prompt"])
    distance = F.struct(F.abs(F.col(size) - F.col("good")[size]), F.col("sample"))
    out = both.groupBy("task_id", "prompt", "good").agg(F.min_by(code, distance).alias("bad"))
    return out.select("task_id", "prompt", F.col("good")[code].alias("good"), "bad")


def best_of(candidates: DataFrame) -> DataFrame:
    """(task_id, best) of candidates (task_id, sample, code, parses): the first that parses, else the first."""
    return candidates.groupBy("task_id").agg(F.min_by("code", F.struct((~F.col("parses")).cast("int"), "sample")).alias("best"))


def harvested(rows: DataFrame, limit: int) -> DataFrame:
    """The first tasks that bring their own tests, of rows (ord, prompt, completion): the asserts are the tests, the rest is the reference and must parse.

    The first rows are gone through, four times as many until they hold `limit` tasks, or all; what comes behind costs its key alone.
    """
    most = 4 * limit
    while True:
        seen, last = rows.select("ord").orderBy("ord").limit(most).agg(F.count("*"), F.max("ord")).first()
        if seen < most or last is None:
            return _harvested(rows).orderBy("ord").limit(limit)
        out = checkpointed(_harvested(rows.where(F.col("ord").isNull() | (F.col("ord") <= F.lit(last)))).orderBy("ord").limit(limit))
        if out.count() == limit:
            return out.orderBy("ord")
        most *= 4


def _harvested(rows: DataFrame) -> DataFrame:
    code = T.unwrapped(F.col("completion"))
    out = rows.select("ord", "prompt", code.alias("code"))
    out = out.select("ord", "prompt", T.assert_lines(F.col("code")).alias("tests"), T.def_names(F.col("code")).alias("names"), F.array_join(T.assert_lines(F.col("code"), others=True), "\n").alias("reference"))
    out = out.where((F.size("tests") > 0) & (F.size("names") > 0)).where(parses(F.col("reference")))
    return out.select(F.concat(F.lit("sft/"), F.col("ord").cast("string")).alias("task_id"), "ord", "prompt", F.array_join("tests", "\n").alias("test_code"), F.element_at("names", -1).alias("entry_point"), "reference")


def rotated(checkpoints: DataFrame, keep: int = 2) -> DataFrame:
    """Of checkpoints (run, path, step), those to delete: all but the newest."""
    return numbered(checkpoints, F.desc("step"), "path", by=["run"]).where(F.col("rn") > keep).drop("rn")
