"""Readers: tables and JSON lines as DataFrames with a stable order key, and the loaders of benchmark tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.config import BY_NAME, Source
from corpuskit.functions import text as X
from corpuskit.operators.filters import is_python, prose_wanted, under_cap
from corpuskit.operators.mix import first_rows

RECORD = T.StructType([
    T.StructField("task_id", T.StringType()), T.StructField("sample", T.IntegerType()), T.StructField("outcome", T.StringType()),
    T.StructField("detail", T.StringType()), T.StructField("parses", T.BooleanType()), T.StructField("code", T.StringType()),
])
SAMPLE_GROUP = T.StructType([
    T.StructField("task_id", T.StringType()), T.StructField("prompt", T.StringType()),
    T.StructField("samples", T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("outcome", T.StringType())]))),
])
TASK = "task_id string, prompt string, test_code string, entry_point string, setup_code string, reference string, meta map<string,string>"


def read(spark: SparkSession, path: str, format_: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """A file, or a folder of files; a schema spares JSON and CSV the pass that would infer one."""
    reader = spark.read.format(format_)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def ordered(df: DataFrame, key: Column | str) -> DataFrame:
    """df with the column ord to which all order and randomness refer."""
    return df.withColumn("ord", F.col(key) if isinstance(key, str) else key)


def documents_of(df: DataFrame, source: Source | str, cap: int | None = None, blank: bool = False) -> DataFrame:
    """(source, ord, text) of a raw source table with its own columns and ord: its language and length filters, and its template.

    Null texts, languages, audiences and formats are dropped, and so is what is blank. With `blank`, code and prose lose the blanks at their
    ends alone, as by SQL's trim(), and stay if nothing is left.
    """
    s = BY_NAME[source] if isinstance(source, str) else source
    cap = s.cap if cap is None else cap
    body = F.col(s.response)
    short = under_cap(body, cap)
    if s.kind == "code":
        keep, text = short & (F.length(body) > 0), X.fenced_python(F.trim(body, F.lit(X.BLANKS))) if blank else X.as_fenced_python(body)
    elif s.kind == "prose":
        keep, text = short & prose_wanted(F.col("audience"), F.col("format")), F.trim(body, F.lit(X.BLANKS)) if blank else X.blank_to_null(body)
    else:
        wanted = is_python(F.col(s.language)) if s.language else X.looks_python(F.concat(F.col(s.prompt), body))
        keep, text = short & wanted, X.as_task(F.col(s.prompt), body)
    out = df.where(keep).select(F.lit(s.name).alias("source"), "ord", text.alias("text"))
    return out if blank and s.kind != "instruct" else out.where(X.has_text(F.col("text")))


def instruct_rows(df: DataFrame, source: Source | str, limit: int | None = None, max_chars: int = 3_000) -> DataFrame:
    """(source, ord, prompt, response) of a raw instruction table: the first `limit` rows that survive its language and length filters."""
    s = BY_NAME[source] if isinstance(source, str) else source
    keep = under_cap(F.col(s.response), max_chars, inclusive=True)
    if s.language:
        keep = keep & is_python(F.col(s.language), versions=True)
    out = df.where(keep).select(F.lit(s.name).alias("source"), "ord", F.coalesce(s.prompt, F.lit("")).alias("prompt"), F.col(s.response).alias("response"))
    return out if limit is None else first_rows(out, limit, "ord")


def split_texts(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The texts of one split of a saved corpus; the other columns and splits aren't read."""
    return spark.read.parquet(path).where(F.col("split") == split).select("text")


def peek(df: DataFrame, by: str = "source", text: str = "text", order: str = "ord") -> DataFrame:
    """The first row of each source: how long its text is, and how many characters are beyond ASCII."""
    first = df.groupBy(by).agg(F.min_by(text, order).alias("t"))
    return first.select(by, F.length("t").alias("chars"), X.non_ascii(F.col("t")).alias("non_ascii"))


def mbpp(df: DataFrame, limit: int | None = None, text: str = "text", code: str = "code") -> DataFrame:
    """Tasks of (task_id, text, code, test_list, test_setup_code); those without tests are dropped."""
    task = F.concat(X.strip(F.col(text)), F.lit("\nYour code should satisfy: "), F.element_at("test_list", 1))
    out = df.where(F.size("test_list") > 0).orderBy("task_id")
    out = out.select(
        F.concat(F.lit("mbpp/"), F.col("task_id").cast("string")).alias("task_id"), X.framed_prompt(task).alias("prompt"), F.array_join("test_list", "\n").alias("test_code"),
        X.entry_point(F.col(code)).alias("entry_point"), F.coalesce("test_setup_code", F.lit("")).alias("setup_code"), F.col(code).alias("reference"), F.create_map().cast("map<string,string>").alias("meta"),
    )
    return out if limit is None else out.limit(limit)


def humaneval(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Tasks of (task_id, prompt, test, entry_point, canonical_solution)."""
    task = F.concat(F.lit("Complete the following function.\n\n"), X.fenced_python(X.strip(F.col("prompt"))))
    out = df.select(
        "task_id", X.framed_prompt(task).alias("prompt"), F.concat(F.col("test"), F.lit("\ncheck("), F.col("entry_point"), F.lit(")")).alias("test_code"),
        "entry_point", F.lit("").alias("setup_code"), F.concat("prompt", "canonical_solution").alias("reference"), F.create_map().cast("map<string,string>").alias("meta"),
    ).orderBy("task_id")
    return out if limit is None else out.limit(limit)


LOADERS: dict[str, Callable[..., DataFrame]] = {"mbpp": mbpp, "humaneval": humaneval}


def records(spark: SparkSession, path: str, schema: T.StructType = RECORD, strict: bool = False) -> DataFrame:
    """JSON lines. A line that isn't JSON, such as one torn by a crash, is skipped, or stops the job if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def parsed(line: Column, schema: T.StructType = RECORD) -> Column:
    """A JSON line as a record; null if it isn't one, such as a torn line."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return F.when(F.try_parse_json(line).isNotNull(), F.from_json(line, names))


def done_keys(spark: SparkSession, path: str, keys: tuple[str, ...] = ("task_id", "sample"), schema: T.StructType = RECORD) -> DataFrame:
    """The distinct keys of all whole lines that have them."""
    out = records(spark, path, schema).select(*keys)
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    return out.distinct()


def malformed(spark: SparkSession, path: str) -> int:
    """How many lines aren't JSON."""
    return spark.read.text(path).where((X.strip(F.col("value")) != "") & F.try_parse_json("value").isNull()).count()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
