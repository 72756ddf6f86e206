"""Personal data by information-theoretic sanitisation.

Entities to protect are found by their form (addresses, numbers, keys; card numbers by their check digit too) and generalised to their
class. What else reveals one is learned from the corpus: for each entity, its mentions are counted, those of them that have a
term within WINDOW words, and each such term's occurrences, all over the whole corpus. With these, a term t discloses of
entity c the share PMI(c; t) / IC(c) of its information content, which is 1 if t occurs with c alone, however often their rows repeat.
It counts if their meeting isn't chance: if so many distinct contexts of c as have t would, with t scattered at random, be that many with a
chance of at most ALPHA (by Chernoff's bound on the Poisson tail). In documents that mention c, such terms of a share of at least
REMOVE go; those of at least GENERALISE become a class of theirs: <NUMBER> of digits only, <NAME> if written with a capital, else <TERM>.

A term is a maximal run of letters and digits, in lower case. Defined results: a null text stays null and has 0 of
either; an empty one stays as it is; repeated rows are all sanitised alike, and their equal contexts are one as evidence; rows of one id that have
entities share the terms that these disclose; rows of null id have their entities generalised, but no terms; of entities that overlap, the class
named first in ENTITIES counts; a term's share of several entities is the highest; very long texts are searched whole; documents
without entities stay as they are; an empty table gives an empty one. Other columns keep their names and values.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm._spark import cut, free_name, maybe_broadcast, small

WINDOW, ALPHA, GENERALISE, REMOVE = 8, 1e-3, 0.9, 0.97

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_END = r"(?![A-Za-z0-9])"
#: In order of precedence. No pattern matches white space at its ends. Each begins with what few places have, and looks back only there.
ENTITIES: dict[str, str] = {
    "KEY": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"
    rf"|A(?<![A-Za-z0-9]A)(?:KIA|SIA)[0-9A-Z]{{16}}{_END}"
    r"|(?:g(?<![A-Za-z0-9]g)(?:h[pousr]_|ithub_pat_|lpat-)|s(?<![A-Za-z0-9]s)k[\-_]|p(?<![A-Za-z0-9]p)k_live_|x(?<![A-Za-z0-9]x)ox[abprs]-|A(?<![A-Za-z0-9]A)Iza)[A-Za-z0-9_\-]{16,}"
    r"|e(?<![A-Za-z0-9]e)yJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]+)?"
    r"|(?i:(?:p(?:ass(?:word|wd|phrase)|wd|rivate[_\-]?key)|secret|a(?:pi[_\-]?key|ccess[_\-]?key)|token)[a-z0-9_]*[ ]?[=:][ ]?(?:\"[^\"\n]{4,}\"|'[^'\n]{4,}'|[^\s\"',;]{5,}[^\s\"',;.:!?]))"
    rf"|(?<![A-Za-z0-9])(?:[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+){_END}(?<=[0-9][A-Fa-f]{{0,24}})",
    "EMAIL": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "IBAN": rf"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "IP": rf"[0-9](?<![0-9A-Za-z.][0-9])(?<=(?=[0-9.]{{7}})[0-9])(?<=(?={_OCTET}\.)[0-9])[0-9]{{0,2}}\.(?:{_OCTET}\.){{2}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])|(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}(?![0-9A-Za-z:])",
    "NATIONAL_ID": r"[0-9](?<![0-9A-Za-z\-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "CARD": rf"[0-9](?<![0-9A-Za-z.][0-9])(?:[ \-]?[0-9]){{12,18}}{_END}",
    "PHONE": rf"\+(?<![0-9A-Za-z]\+)(?=(?:[ .\-()]{{0,2}}[0-9]){{8}})[0-9]{{1,3}}(?:[ .\-]?\([0-9]{{1,4}}\))?(?:[ .\-]?[0-9]{{1,4}}){{2,6}}{_END}"
    rf"|\((?<![0-9A-Za-z]\()[0-9]{{2,4}}\)[ .\-]?[0-9]{{3,4}}[ .\-]?[0-9]{{3,4}}{_END}"
    rf"|[0-9](?<![0-9A-Za-z.\-][0-9])[0-9]{{2}}([ .\-])[0-9]{{3}}\1[0-9]{{4}}{_END}",
}
#: Every entity has one of these, so most texts need no more than a look for them.
_HINT = r"[0-9@=:]|A(?:[KS]IA|Iza)|eyJ|g(?:h[pousr]_|ithub_pat_|lpat-)|sk[\-_]|pk_live_|xox[abprs]-|-----BEGIN"
_ANY = "|".join(f"(?:{p})" for p in ENTITIES.values()).replace(r"\1", "[ .\\-]")
_BETWEEN = r"[^\p{L}\p{N}]+"
_LEFT, _RIGHT = r"(?iu)(?<![\p{L}\p{N}<])(?:", r")(?![\p{L}\p{N}])"


_MARKED = ("NUMBER", "NAME", "TERM")


def _cards(text: Column, keep: str, other: str) -> Column:
    """The text with each number that has a card's form replaced: by `keep` if its check digit is right, else by `other` (where $0 is itself)."""
    form = ENTITIES["CARD"]
    found = F.regexp_extract_all(text, F.lit(f"({form})"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, "[ -]", "")
    new = lambda rule, x: F.concat(*(x if part == "$0" else F.lit(part) for part in re.split(r"(\$0)", rule) if part))
    turned = F.transform(found, lambda x: F.when(F.call_function("luhn_check", digits(x)), new(keep, x)).otherwise(new(other, x)))
    parts = F.split(text, form)
    rebuilt = F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get(turned, i), F.lit("")))), "")
    return F.when(text.rlike(r"[0-9](?:[ \-]?[0-9]){12}"), rebuilt).otherwise(text)


def generalised(text: Column) -> Column:
    """The text with each entity replaced by its class."""
    each = lambda t, e: _cards(t, "<CARD>", "$0") if e[0] == "CARD" else F.regexp_replace(t, e[1], f"<{e[0]}>")
    return F.when(text.rlike(_HINT), reduce(each, ENTITIES.items(), text)).otherwise(text)


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")


def _marked(docs: DataFrame) -> DataFrame:
    """(id, spans: array of (entity, context: array of terms), words: distinct terms) of each text (id, text) that has entities; an entity's own terms and other entities' are no context."""
    # A number that isn't a card's has a letter put before it, with which it is no entity.
    hinted = docs.where(F.col("text").rlike(_HINT)).select("id", _cards(F.col("text"), "$0", "n$0").alias("text"))
    found = F.regexp_extract_all("text", F.lit(f"({_ANY})"), F.lit(1))
    marked = hinted.select("id", "text", found.alias("e")).where("size(e) > 0").select("id", "e", F.split("text", _ANY).alias("s"), F.array_distinct(_terms(F.col("text"))).alias("words"))
    near = marked.select("id", "e", "words", F.transform("s", _terms).alias("s"))

    def span(entity: Column, i: Column) -> Column:
        before = F.get("s", i)
        last = F.slice(before, F.greatest(F.size(before) - (WINDOW - 1), F.lit(1)), F.lit(WINDOW))
        return F.struct(F.lower(entity).alias("entity"), F.concat(last, F.slice(F.get("s", i + 1), 1, WINDOW)).alias("context"))

    return near.select("id", F.transform("e", span).alias("spans"), "words")


def mentions(docs: DataFrame) -> DataFrame:
    """(id, entity, context) of each entity in the texts (id, text)."""
    return _each(_marked(docs))


def _each(marked: DataFrame) -> DataFrame:
    return marked.select("id", F.explode("spans").alias("x")).select("id", "x.entity", "x.context")


def disclosures(docs: DataFrame, alpha: float = ALPHA, generalise: float = GENERALISE, found: DataFrame | None = None) -> DataFrame:
    """(entity, term, share) of the terms of the texts (id, text) that disclose at least the share `generalise` of an entity, and not by chance."""
    seen = cut((mentions(docs) if found is None else found).groupBy("entity", "context").agg(F.count("*").alias("times")))
    both = seen.select("entity", "times", F.explode(F.array_distinct("context")).alias("term")).groupBy("entity", "term").agg(F.sum("times").alias("n_ct"), F.count("*").alias("k"))
    each = seen.groupBy("entity").agg(F.sum("times").alias("n_c"), F.count("*").alias("contexts"))
    both = cut(both.join(each, "entity"))
    if both.isEmpty():
        return both.select("entity", "term", F.lit(1.0).alias("share"))
    counts = cut(_counted(docs, both.select("term").distinct()))
    n = F.lit(float(counts.agg(F.sum("n_t")).first()[0]))
    # One occurrence can be in the contexts of several mentions, so the share is held to 1.
    pmi = F.log(F.least(F.col("n_ct"), F.col("n_t")) * n / (F.col("n_c") * F.col("n_t")))
    share = F.least(pmi / F.log(n / F.col("n_c")), F.lit(1.0))
    # Expected contexts with t by chance, repeated rows counted once: n_t is scaled down by how often t's contexts repeat.
    expected = 2.0 * WINDOW * F.col("contexts") * F.col("n_t") * F.col("k") / F.col("n_ct") / n
    tail = F.when(expected < F.col("k"), F.col("k") * (1 + F.log(expected) - F.log("k")) - expected).otherwise(0.0)
    return both.join(counts, "term").where(share >= generalise).where(tail <= float(math.log(alpha))).select("entity", "term", share.alias("share"))


def _counted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t) of the wanted terms over all texts; null stands for all other terms together, or each has its row if the wanted are too many to broadcast."""
    words = docs.select(F.explode(F.split(F.lower("text"), _BETWEEN)).alias("term")).where("term <> ''")
    if small(wanted):
        words = words.join(F.broadcast(wanted.withColumn("w", F.col("term"))), "term", "left").select(F.col("w").alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n_t"))


def _without(text: Column, terms: Column, by: str | None) -> Column:
    """The text with the terms replaced; by None, each by its class."""
    any_ = F.array_join(terms, "|")
    if by is not None:
        new = F.regexp_replace(text, F.concat(F.lit(_LEFT), any_, F.lit(_RIGHT)), F.lit(by))
    else:
        new = text
        for form, name in zip((r"(?=\p{N}+(?![\p{L}\p{N}]))", r"(?=\p{Lu})", ""), _MARKED, strict=True):
            new = F.regexp_replace(new, F.concat(F.lit(r"(?u)(?<![\p{L}\p{N}<])" + form + "(?i:"), any_, F.lit(_RIGHT)), F.lit(f"<{name}>"))
    return F.when(F.size(terms) > 0, new).otherwise(text)


def _sanitised(docs: DataFrame, id_col: str, text_col: str, alpha: float, generalise: float, remove: float) -> tuple[DataFrame, dict[str, str]]:
    """docs with the clean text and two counts in columns whose names are given, too."""
    name = {k: free_name(docs, k) for k in ("pii_text", "pii_entities", "pii_terms", "pii_id", "pii_soft", "pii_hard")}
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = cut(_marked(pairs))
    found = _each(marked)
    shares = maybe_broadcast(disclosures(pairs, alpha, generalise, found))
    # A document's own words are held against the terms, so that no entity's terms meet all its documents.
    named = marked.where("id is not null")
    has = named.select("id", F.explode("words").alias("term")).join(shares, "term")
    per_doc = has.join(_each(named).select("id", "entity").distinct(), ["id", "entity"], "left_semi").groupBy("id", "term").agg(F.max("share").alias("share"))
    per_doc = cut(per_doc.groupBy(F.col("id").alias(name["pii_id"])).agg(
        F.array_sort(F.collect_list(F.when(F.col("share") < remove, F.col("term")))).alias(name["pii_soft"]),
        F.array_sort(F.collect_list(F.when(F.col("share") >= remove, F.col("term")))).alias(name["pii_hard"]),
    ))
    text, new = F.col(text_col), F.col(name["pii_text"])
    classes = F.lit("<(?:" + "|".join(ENTITIES) + ")>")
    # A class that the text names itself is no entity of it.
    entities = F.when(new == text, 0).otherwise(F.regexp_count(new, classes) - F.regexp_count(text, classes))
    out = docs.withColumn(name["pii_text"], generalised(text)).withColumn(name["pii_entities"], F.coalesce(entities, F.lit(0)))
    out = _joined_few(out, per_doc, id_col, name["pii_id"], name["pii_entities"])
    empty = F.array().cast("array<string>")
    soft, hard = F.coalesce(F.col(name["pii_soft"]), empty), F.coalesce(F.col(name["pii_hard"]), empty)
    both = F.concat(soft, hard)
    gone = F.when(F.size(both) > 0, F.regexp_count(new, F.concat(F.lit(_LEFT), F.array_join(both, "|"), F.lit(_RIGHT)))).otherwise(0)
    return out.withColumn(name["pii_terms"], F.coalesce(gone, F.lit(0))).withColumn(name["pii_text"], _without(_without(new, hard, ""), soft, None)), name


def _joined_few(docs: DataFrame, few: DataFrame, id_col: str, few_id: str, entities: str) -> DataFrame:
    """docs left joined with few, which has rows of a small part of their ids. Where few is too large to broadcast, only the documents that have entities are shuffled."""
    on = F.col(id_col) == F.col(few_id)
    if small(few):
        return docs.join(F.broadcast(few), on, "left")
    has = F.coalesce(F.col(entities) > 0, F.lit(False))
    rest = docs.where(~has)
    for c in few.columns:
        rest = rest.withColumn(c, F.lit(None).cast(few.schema[c].dataType))
    return docs.where(has).join(few, on, "left").unionByName(rest)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(id_col, text_col, entities, terms): each row's clean text, and how many entities and terms are gone from it."""
    out, name = _sanitised(docs.select(id_col, text_col), id_col, text_col, alpha, generalise, remove)
    return out.select(id_col, F.col(name["pii_text"]).alias(text_col), F.col(name["pii_entities"]).alias("entities"), F.col(name["pii_terms"]).alias("terms"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with clean texts, all columns in their order; a column of the texts' lengths is brought up to date."""
    out, name = _sanitised(docs, id_col, text_col, ALPHA, GENERALISE, REMOVE)
    new = F.col(name["pii_text"])
    changed = (F.col(name["pii_entities"]) > 0) | (F.col(name["pii_terms"]) > 0)
    length = lambda c: F.when(changed, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c))
    return out.select(*(new.alias(c) if c == text_col else length(c).alias(c) if c == chars_col else F.col(c) for c in docs.columns))
