"""Text expressions. Every regular expression of the library is here, in the dialect that Java and RE2 share where an oracle needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() removes, Java's trim() would not.
SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What SQL's trim() removes: blanks of every width, but no other white space.
BLANKS = "".join(map(chr, [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
FENCE = "`" * 3

#: A closed fenced block: its tag, then its body.
_TAG = "[-+_0-9A-Za-z]*"
FENCED = rf"(?s)`{{3}}({_TAG})[\t ]*\n(.*?)`{{3}}"
#: A fenced block that may lack its end.
OPEN_FENCED = rf"(?s)`{{3}}{_TAG}[\t\n\v\f\r ]*\n(.*?)(?:`{{3}}|\z)"
#: Line starts are those after \n alone, and \s and \w are Unicode's, as in Python; hence the flags.
DEF = r"(?mdU)^\s*def\s+([_A-Za-z]\w*)"
DEF_OR_CLASS = r"(?mdU)^\s*(?:class|def)\s+([_A-Za-z]\w*)"
WORD = r"[a-z0-9_]+"
ASKS_CODE = r"(?i)\b(algorithm|calculate|class|code|compute|convert|create|def|function|generate|implement|method|parse|program|return|script|snippet|sort|write)\b"
CONCEPTUAL = r"(?i)^\s*(describe|explain|how does|what are|what is|what's the difference|when should|why does|why is)\b"

FOREIGN_CODE = ("await fetch", "extern ", "fn main()", "namespace ", "printf(", "public class ", "std::", "using namespace std")
#: A capital letter keeps this one from ever being found in lower-cased text, unless one asks for strictness.
FOREIGN_CODE_CAPITAL = ("System.out.print",)
#: "js " and "java " end in a blank, so that a fence line that ends with the tag isn't met.
FOREIGN_TAGS = ("c#", "c++", "cpp", "csharp", "golang", "java ", "javascript", "js ", "ruby", "rust", "sql", "swift")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def blank_to_null(text: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def words(text: Column) -> Column:
    """The distinct words of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def containment(a: Column, b: Column) -> Column:
    """What part of the smaller set of words the other has; null if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def fenced_blocks(text: Column) -> Column:
    """Array of (lang, body) of the closed fenced blocks, tags in lower case."""
    tags = F.transform(F.regexp_extract_all(text, F.lit(FENCED), F.lit(1)), F.lower)
    return F.arrays_zip(tags.alias("lang"), F.regexp_extract_all(text, F.lit(FENCED), F.lit(2)).alias("body"))


def def_names(code: Column, classes: bool = False) -> Column:
    return F.regexp_extract_all(code, F.lit(DEF_OR_CLASS if classes else DEF), F.lit(1))


def entry_point(code: Column, otherwise: str = "solution") -> Column:
    """The last function or class that the code defines."""
    return F.coalesce(F.try_element_at(def_names(code, classes=True), F.lit(-1)), F.lit(otherwise))


def asks_code(prompt: Column) -> Column:
    return prompt.rlike(ASKS_CODE)


def conceptual(prompt: Column) -> Column:
    return prompt.rlike(CONCEPTUAL)


def looks_python(text: Column, strict: bool = False) -> Column:
    t = F.lower(text)
    foreign = [*FOREIGN_CODE, *((k.lower() for k in FOREIGN_CODE_CAPITAL) if strict else FOREIGN_CODE_CAPITAL), *(FENCE + tag for tag in FOREIGN_TAGS)]
    other = F.lit(False)
    for k in foreign:
        other = other | t.contains(k)
    return ~other & (t.contains("python") | (t.contains("def ") & t.contains("import ")))


def non_ascii(text: Column) -> Column:
    """The number of characters beyond ASCII."""
    return F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))


def lines(text: Column) -> Column:
    """The lines as Python's splitlines() gives them."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


# --- templates


def framed_prompt(task: Column) -> Column:
    return F.concat(F.lit("## Task\n"), task, F.lit("\n\n## Solution\n"))


def as_task(prompt: Column, response: Column) -> Column:
    """Both sides framed as one document; null if either is blank."""
    return F.concat(framed_prompt(blank_to_null(prompt)), blank_to_null(response))


def fenced_python(code: Column) -> Column:
    return F.concat(F.lit(FENCE + "python\n"), code, F.lit("\n" + FENCE))


def as_fenced_python(code: Column) -> Column:
    return fenced_python(blank_to_null(code))


def bare_task(framed: Column) -> Column:
    """The task's own words, out of the frame and without its line of example tests."""
    marker, end = "## Task\n", "\n\n## Solution"
    at = F.locate(marker, framed)
    body = F.when(at > 0, F.substr(framed, at + F.lit(len(marker)))).otherwise(framed)
    kept = F.filter(lines(F.substring_index(body, end, 1)), lambda ln: ~F.startswith(ln, F.lit("Your code should satisfy:")))
    return F.array_join(kept, "\n")


def extract_code(completion: Column) -> Column:
    """The first fenced block, closed or not, without blank lines at its ends; the stripped text if there is none."""
    return F.when(completion.rlike(OPEN_FENCED), F.trim(F.regexp_extract(completion, OPEN_FENCED, 1), F.lit("\n"))).otherwise(strip(completion))


def before_fence(text: Column) -> Column:
    return F.trim(F.substring_index(text, FENCE, 1), F.lit("\n"))


def unwrapped(completion: Column) -> Column:
    """The code of a fenced completion: no backticks at the ends, and the first language line gone."""
    bare = F.trim(completion, F.lit("`"))
    at = F.locate("python\n", bare)
    return F.when(at > 0, F.concat(F.substr(bare, F.lit(1), at - 1), F.substr(bare, at + F.lit(7)))).otherwise(bare)


def assert_lines(code: Column, others: bool = False) -> Column:
    """Array of the lines that assert something, or of the others."""
    is_assert = lambda ln: F.startswith(strip(ln), F.lit("assert "))
    return F.filter(lines(code), (lambda ln: ~is_assert(ln)) if others else is_assert)


# --- draws


def draw(key: Column, purpose: str, seed: int = 1738) -> Column:
    """A number in [0, 1) that depends on the key, the seed and the purpose alone."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(purpose)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def shuffle_key(key: Column, seed: int = 1738) -> Column:
    """Sorting by this puts rows in a random order that is the same for any partitioning."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"))
