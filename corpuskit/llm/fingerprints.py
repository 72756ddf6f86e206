"""Document fingerprints by threshold-scaled sketches.

A document's shingles are its runs of k white-space-separated lower-cased words; its sketch holds every
distinct shingle hash below FRACTION of the hash range. As the threshold is the same for all, the sketch of a
union is the union of sketches, and the share of a small document that a large one contains is estimated
as well as that of an equal: by what part of the small sketch is in the large one.

sketches() gives one row an id; merge() and containment() work on columns. in_corpus() also estimates how much
of each document the rest of the corpus contains: the part of its sketch that some other id has too. containers() searches for
pairs: of each query, the documents that contain it or that it contains to the part LEAST or more. Documents of equal sketches are one class,
under their least id. A pair is looked for by each side's rarest hashes alone, as many as could all be missing and one more, so what many documents
share pairs those only that consist of it; no pair of the part LEAST is lost by that.

Defined results: a text of fewer than k words is one shingle; a null, empty or blank text has none, an empty sketch and
null containment, as has one of which no hash falls below the threshold; repeated rows and several texts of one id
merge, and their shingle numbers add up; null ids are one id, which is neither query nor match; of equally rare hashes the least come first; very long
texts are sketched whole; an empty table gives an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm._spark import cut

K, FRACTION, LEAST = 5, 1 / 12, 0.5
#: The query set of op5_containment: ids divisible by this.
EVERY = 50


def threshold(fraction: float) -> str:
    """The hexadecimal digest at the fraction of the range: md5 digests below it, as strings, are kept."""
    return "g" if fraction >= 1 else f"{int(fraction * 16**15):015x}"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\r\f]+"), lambda w: w != "")


def _sketch(words: Column, k: int, fraction: float) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
    digests = F.transform(starts, lambda i: F.md5(F.array_join(F.slice(words, i, k), " ").cast("binary")))
    low = F.filter(digests, lambda d: d < threshold(fraction))
    return F.transform(F.array_distinct(low), lambda d: F.conv(F.substring(d, 1, 15), 16, 10).cast("bigint"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, fraction: float = FRACTION) -> DataFrame:
    """(id_col, n_shingles, sketch): the sorted hashes kept of each id's texts."""
    words = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("w"))
    some = F.size("w") > 0
    each = words.select(
        "id",
        F.when(some, F.greatest(F.size("w") - (k - 1), F.lit(1))).otherwise(0).cast("bigint").alias("n"),
        F.when(some, _sketch(F.col("w"), k, fraction)).otherwise(F.array().cast("array<bigint>")).alias("s"),
    )
    if _unique(words):
        return each.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.array_sort("s").alias("sketch"))
    merged = each.groupBy("id").agg(F.sum("n").alias("n_shingles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("sketch"))
    return merged.withColumnRenamed("id", id_col)


def _unique(rows: DataFrame) -> bool:
    """Whether no id occurs twice, null included; only the ids are read."""
    n, distinct, some = rows.agg(F.count("*"), F.count_distinct("id"), F.count("id")).first()
    return distinct + (n - some) == n and n - some <= 1


def merge(a: Column, b: Column) -> Column:
    """The sketch of both documents together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def in_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, fraction: float = FRACTION) -> DataFrame:
    """(id_col, n_shingles, sketch, shared, containment): shared counts the hashes that another id has too, containment is their share."""
    made = cut(sketches(docs, id_col, text_col, k, fraction).withColumnRenamed(id_col, "id"))
    each = made.select("id", F.explode("sketch").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = each.join(common, "h").groupBy("id").agg(F.count("*").alias("shared"))
    joined = made.join(shared.withColumnRenamed("id", "other"), F.col("id").eqNullSafe(F.col("other")), "left")
    n = F.coalesce("shared", F.lit(0))
    return joined.select(F.col("id").alias(id_col), "n_shingles", "sketch", n.alias("shared"), F.when(F.size("sketch") > 0, n / F.size("sketch")).alias("containment"))


def containers(docs: DataFrame, is_query: Column, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", k: int = K, fraction: float = FRACTION) -> DataFrame:
    """(id_col, match, copies, shared, containment, contained): for each query id, the classes of other documents, by their least id and number, that have at least the share `least` of its hashes (containment), or it of theirs (contained)."""
    made = sketches(docs, id_col, text_col, k, fraction).withColumnRenamed(id_col, "id").where("id is not null and size(sketch) > 0")
    made = cut(made.select("id", "sketch", is_query.alias("asks")))
    classes = cut(made.groupBy("sketch").agg(F.min("id").alias("c"), F.count("*").alias("copies"), F.max("asks").alias("asks")))
    each = classes.select("c", "asks", F.size("sketch").alias("size"), F.explode("sketch").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(each.join(common, "h").select("c", "asks", "size", "h", "n"))
    # A class's rarest hashes are those that no other has; they need no row.
    own = shared.groupBy("c", "asks", "size").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("hs"))
    wanted = F.floor(F.col("size") * (1 - least) + 1e-9) + 1 - (F.col("size") - F.size("hs"))
    rare = cut(own.select("c", "asks", F.explode(F.slice("hs", F.lit(1), F.greatest(wanted, F.lit(0)).cast("int"))).alias("x")).select("c", "asks", "x.h"))
    asking = rare.where("asks").select(F.col("c").alias("q"), "h").join(shared.select(F.col("c").alias("d"), "h"), "h")
    asked = shared.where("asks").select(F.col("c").alias("q"), "h").join(rare.select(F.col("c").alias("d"), "h"), "h")
    pairs = asking.unionByName(asked).where("q <> d").select("q", "d").distinct()
    side = lambda name: classes.select(F.col("c").alias(name), F.col("sketch").alias(f"{name}_s"), F.col("copies").alias(f"{name}_n"))
    both = pairs.join(side("d"), "d").join(side("q"), "q").select("q", "d", F.col("d_n").alias("copies"), F.size(F.array_intersect("q_s", "d_s")).cast("bigint").alias("shared"), F.size("q_s").alias("size_q"), F.size("d_s").alias("size_d"))
    # Other ids of a query's own class contain it wholly.
    same = classes.where("asks and copies > 1").select(F.col("c").alias("q"), F.col("c").alias("d"), (F.col("copies") - 1).alias("copies"), F.size("sketch").cast("bigint").alias("shared"), F.size("sketch").alias("size_q"), F.size("sketch").alias("size_d"))
    found = both.unionByName(same).select("q", F.col("d").alias("match"), "copies", "shared", (F.col("shared") / F.col("size_q")).alias("containment"), (F.col("shared") / F.col("size_d")).alias("contained"))
    found = found.where(F.greatest("containment", "contained") >= least)
    queries = made.where("asks").select("id", "sketch").join(classes.select("sketch", F.col("c").alias("q")), "sketch").select("id", "q")
    return queries.join(found, "q").select(F.col("id").alias(id_col), "match", "copies", "shared", "containment", "contained")


IN_CORPUS_SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] ELSE list_transform(generate_series(1, greatest(len(w) - {K - 1}, 1)), lambda i: md5(array_to_string(w[i:i + {K - 1}], ' '))) END AS m FROM words
), counted AS (
  SELECT doc_id, sum(len(m))::BIGINT AS n_shingles FROM shingled GROUP BY doc_id
), kept AS (
  SELECT DISTINCT doc_id, ('0x' || d[1:15])::BIGINT AS h FROM (SELECT doc_id, unnest(m) AS d FROM shingled) WHERE d < '{threshold(FRACTION)}'
), common AS (
  SELECT h FROM kept GROUP BY h HAVING count(*) > 1
), summed AS (
  SELECT k.doc_id, string_agg(k.h::VARCHAR, ',' ORDER BY k.h) AS sketch, count(*) AS n, count(c.h) AS shared FROM kept k LEFT JOIN common c USING (h) GROUP BY k.doc_id
)
SELECT counted.doc_id, n_shingles, coalesce(sketch, '') AS sketch, coalesce(shared, 0)::BIGINT AS shared, round(shared / n, 9) AS containment
FROM counted LEFT JOIN summed ON counted.doc_id IS NOT DISTINCT FROM summed.doc_id
"""

CONTAINERS_SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), shingled AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] ELSE list_transform(generate_series(1, greatest(len(w) - {K - 1}, 1)), lambda i: md5(array_to_string(w[i:i + {K - 1}], ' '))) END AS m FROM words
), kept AS (
  SELECT DISTINCT doc_id, ('0x' || d[1:15])::BIGINT AS h FROM (SELECT doc_id, unnest(m) AS d FROM shingled) WHERE d < '{threshold(FRACTION)}'
), sketched AS (
  SELECT doc_id, md5(string_agg(h::VARCHAR, ',' ORDER BY h)) AS s, count(*) AS n FROM kept GROUP BY doc_id
), classes AS (
  SELECT s, min(doc_id) AS c, count(*) AS copies, any_value(n) AS n FROM sketched GROUP BY s
), hashes AS (
  SELECT c, h FROM classes JOIN kept ON doc_id = c
), pairs AS (
  SELECT a.c AS q, b.c AS d, count(*) AS shared FROM hashes a JOIN hashes b USING (h)
  WHERE a.c IN (SELECT c FROM sketched JOIN classes USING (s) WHERE doc_id % {EVERY} = 0) GROUP BY ALL
), found AS (
  SELECT q, d AS match, x.copies - (q = d)::INTEGER AS copies, shared, shared / y.n AS containment, shared / x.n AS contained FROM pairs JOIN classes x ON x.c = d JOIN classes y ON y.c = q
)
SELECT doc_id, match, found.copies, shared, round(containment, 9) AS containment, round(contained, 9) AS contained
FROM found JOIN classes ON c = q JOIN sketched USING (s) WHERE doc_id % {EVERY} = 0 AND greatest(containment, contained) >= {LEAST} AND found.copies > 0
"""
