"""URL filters by a temporal list join.

A list is a log of dated entries (pattern, date, action): "add" lists a pattern from its date on, "remove" takes it
off. The log becomes validity intervals [from, to) of each pattern, and an as-of join holds every capture of a URL against the
entries that were active when it was fetched. A pattern is a host name, which covers its subdomains, or a
host and the beginning of a path ("example.com/ads"), in whole segments. A capture's URL is expanded to all patterns
that could cover it, so the join is on equality of patterns, with the time compared in each match.

Defined results: patterns and hosts are compared in lower case, without scheme, user, port, "www." or final dot; very long paths are expanded as deep as the list's deepest pattern; of several entries of
one pattern and instant "remove" counts; repeated entries, and an "add" of what is listed, change nothing; a null or blank pattern,
null date or unknown action is no entry; a URL may lack its scheme if it begins with a host name; the host of a numeric address has no parents; a null or hostless URL, or a null fetch time, matches nothing and is not blocked; repeated
captures are each answered; empty tables give empty results, or no block. Of several active entries the longest pattern is
named, then the least list name. Other columns of the captures are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm._spark import free_name, maybe_broadcast

_HOST = r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:www\.)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+?)\.?(?::[0-9]*)?(?:[/?#]|$)"
_PATH = r"^(?:[a-z][a-z0-9+.\-]*:)?//[^/?#]*/([^?#]*)"


#: What begins with a name of several labels, though no scheme is before it.
_BARE = r"^[a-z0-9_\-]+(?:\.[a-z0-9_\-]+)*\.[a-z]{2,}\.?(?::[0-9]+)?(?:[/?#]|$)"


def _full(url: Column) -> Column:
    """The URL in lower case, with // before a bare host name."""
    u = F.lower(F.trim(url))
    return F.when(u.rlike(_BARE), F.concat(F.lit("//"), u)).otherwise(u)


def host(url: Column) -> Column:
    """The host of a URL; null if it has none, or one of over 253 characters, which no name can have."""
    found = F.regexp_extract(_full(url), _HOST, 1)
    return F.when(F.length(found).between(1, 253), found)


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")


def pattern(text: Column) -> Column:
    """A list entry in the form in which it is compared: host and segments of the path."""
    u = F.lower(F.trim(text))
    u = F.when(u.rlike(r"^(?:[a-z][a-z0-9+.\-]*:)?//"), u).otherwise(F.concat(F.lit("//"), u))
    name = F.regexp_extract(u, _HOST, 1)
    return F.when(F.length(name).between(1, 253), F.concat_ws("/", F.array(name), _segments(u)))


def covering(url: Column, segments: int) -> Column:
    """All patterns of up to so many segments that cover a URL: its host and parent domains, each alone and with leading segments of the path. An address has no parents."""
    name = host(url)
    labels = F.split(name, r"\.")
    upper = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = F.when(name.rlike(r"^(?:\[.*\]|[0-9.]+)$"), F.array(name)).otherwise(upper)
    parts = _segments(_full(url))
    # Slicing by the number of segments there are would give none for an empty path, hence the filter.
    lengths = F.filter(F.sequence(F.lit(0), F.lit(segments)), lambda n: n <= F.size(parts))
    tails = F.transform(lengths, lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))))
    return F.when(name.isNotNull(), F.flatten(F.transform(domains, lambda d: F.transform(tails, lambda t: F.concat(d, t)))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, valid_from, valid_to) of the log (list_name, pattern, entry_date, action); valid_to is null while an entry is active."""
    log = entries.select("list_name", pattern(F.col("pattern")).alias("pattern"), F.col("entry_date").cast("timestamp").alias("at"), F.lower("action").alias("action"))
    log = log.where("pattern is not null and at is not null and action in ('add', 'remove')")
    last = log.groupBy("list_name", "pattern", "at").agg(F.max("action").alias("action"))  # "remove" is greater than "add"
    own = Window.partitionBy("list_name", "pattern").orderBy("at")
    turns = last.withColumn("before", F.lag("action", 1, "remove").over(own)).where("action <> before")
    spans = turns.withColumn("valid_to", F.lead("at").over(own)).where("action = 'add'")
    return spans.select("list_name", "pattern", F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id_col, host, blocked, list_name, pattern, valid_from, active) of each capture; active counts the entries active at its time."""
    spans = maybe_broadcast(intervals(entries)).withColumnRenamed("pattern", "p")
    deepest = spans.agg(F.max(F.regexp_count("p", F.lit("/")))).first()[0] or 0
    # A number for each capture, as rows may repeat: all columns of a result row are functions of these three.
    own = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("t"))
    asked = own.groupBy("id", "url", "t").agg(F.count("*").alias("times"))
    tried = asked.select("*", F.explode_outer(covering(F.col("url"), deepest)).alias("q"))
    active = (F.col("q") == F.col("p")) & (F.col("t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to")))
    hit = F.struct((-F.length("p")).alias("short"), "p", "list_name", "valid_from")
    best = tried.join(spans, active, "left").groupBy("id", "url", "t", "times").agg(F.min(F.when(F.col("p").isNotNull(), hit)).alias("hit"), F.count("p").alias("active"))
    each = best.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return each.select(
        F.col("id").alias(id_col), host(F.col("url")).alias("host"), F.col("hit").isNotNull().alias("blocked"),
        F.col("hit.list_name").alias("list_name"), F.col("hit.p").alias("pattern"), F.col("hit.valid_from").alias("valid_from"), "active",
    )


def allowed(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures, as they were, of the ids of which no capture was blocked."""
    name = free_name(captures, "blocked_id")
    bad = evaluate(captures, entries, id_col, url_col, time_col).where("blocked").select(F.col(id_col).alias(name)).distinct()
    return captures.join(bad, captures[id_col] == bad[name], "left_anti")


# The tables have neither lists nor fetch times. Both are derived from the pages themselves: the time from the id, and for each host
# and its parent domain dated entries by the digest of the name, with removals, returns, repetitions and path patterns among them.


def derived_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.timestamp_seconds(1704067200 + (F.col("page_id") * 7919) % 31536000).alias("fetched_at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host(F.col("url")).alias("h")).where("h is not null").distinct()
    d = hosts.withColumn("m", F.md5(F.col("h").cast("binary")))
    number = lambda begin, n: F.conv(F.substring("m", begin, n), 16, 10).cast("bigint")
    d = d.withColumn("a", number(1, 3) % 365).withColumn("b", number(4, 2) % 120).withColumn("k", number(6, 2) % 8)
    row = lambda name, p, days, action: F.struct(F.lit(name).alias("list_name"), p.alias("pattern"), F.timestamp_seconds(1704067200 + days * 86400).alias("entry_date"), F.lit(action).alias("action"))
    h, parent = F.col("h"), F.concat(F.col("h"), F.lit("/fr"))
    rows = F.array(
        row("spam", h, F.col("a"), "add"), row("spam", h, F.col("a") + F.col("b"), "remove"), row("spam", h, F.col("a") + 2 * F.col("b") + 1, "add"),
        row("spam", h, F.col("a"), "add"), row("adult", parent, F.col("b"), "add"), row("phish", F.concat(F.lit("WWW."), h, F.lit(".")), F.col("a") - 30, "remove"),
    )
    # Of some pages, the page itself.
    own = pages.select(host(F.col("url")).alias("h"), F.slice(_segments(_full(F.col("url"))), 1, 6).alias("p"), F.md5(F.col("url").cast("binary")).alias("m"))
    own = own.where("h is not null and size(p) > 0").where(number(1, 2) % 8 == 0)
    own = own.select(row("page", F.concat_ws("/", F.array("h"), "p"), number(3, 2) % 300, "add").alias("r")).select("r.*").distinct()
    return d.where("k < 3").select(F.explode(rows).alias("r")).select("r.*").unionByName(own)


EVALUATE_SQL = r"""
WITH own AS (
  SELECT page_id, url, CASE WHEN regexp_matches(lower(trim(url)), '^[a-z0-9_\-]+(?:\.[a-z0-9_\-]+)*\.[a-z]{2,}\.?(?::[0-9]+)?(?:[/?#]|$)') THEN '//' ELSE '' END || lower(trim(url)) AS u, make_timestamp((1704067200 + (page_id * 7919) % 31536000) * 1000000) AS t FROM pages
), parsed AS (
  SELECT *, nullif(regexp_extract(u, '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:www\.)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1), '') AS host,
         list_filter(string_split(regexp_extract(u, '^(?:[a-z][a-z0-9+.\-]*:)?//[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM own
), hosts AS (
  SELECT h, ('0x' || m[1:3])::BIGINT % 365 AS a, ('0x' || m[4:5])::BIGINT % 120 AS b, ('0x' || m[6:7])::BIGINT % 8 AS k
  FROM (SELECT DISTINCT host AS h, md5(host) AS m FROM parsed WHERE host IS NOT NULL)
), log AS (
  SELECT 'spam' AS list_name, h AS pattern, a AS day, 'add' AS action FROM hosts WHERE k < 3
  UNION SELECT 'spam', h, a + b, 'remove' FROM hosts WHERE k < 3
  UNION SELECT 'spam', h, a + 2 * b + 1, 'add' FROM hosts WHERE k < 3
  UNION SELECT 'adult', h || '/fr', b, 'add' FROM hosts WHERE k < 3
  UNION SELECT 'phish', h, a - 30, 'remove' FROM hosts WHERE k < 3
  UNION SELECT 'page', host || '/' || array_to_string(parts[1:6], '/'), ('0x' || md5(url)[3:4])::BIGINT % 300, 'add' FROM parsed WHERE host IS NOT NULL AND len(parts) > 0 AND ('0x' || md5(url)[1:2])::BIGINT % 8 = 0
), last AS (
  SELECT list_name, pattern, make_timestamp((1704067200 + day * 86400) * 1000000) AS ts, max(action) AS action FROM log GROUP BY ALL
), turns AS (
  SELECT * FROM (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY list_name, pattern ORDER BY ts) AS prior FROM last) WHERE action <> prior
), spans AS (
  SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY list_name, pattern ORDER BY ts) AS till FROM turns) WHERE action = 'add'
), matched AS (
  SELECT p.page_id, p.host, s.list_name, s.pattern, s.ts FROM parsed p JOIN spans s
  ON (p.host = split_part(s.pattern, '/', 1) OR ends_with(p.host, '.' || split_part(s.pattern, '/', 1)))
  AND p.parts[1:len(string_split(s.pattern, '/')) - 1] = string_split(s.pattern, '/')[2:]
  AND p.t >= s.ts AND (s.till IS NULL OR p.t < s.till)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern, list_name) AS r, count(*) OVER (PARTITION BY page_id) AS active FROM matched
)
SELECT p.page_id, p.host, b.pattern IS NOT NULL AS blocked, b.list_name, b.pattern, epoch(b.ts)::BIGINT AS valid_from, coalesce(b.active, 0)::BIGINT AS active
FROM parsed p LEFT JOIN best b ON b.page_id = p.page_id AND b.r = 1
"""
