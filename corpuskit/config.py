"""Sources, caps, weights and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

SEED = 1738
MAX_DOCS = 2_237_932
VALIDATION_SHARE = 0.05
TOKENIZER_DOCS = 40_000
VOCABULARY_SIZE = 48 * 1024


@dataclass(frozen=True)
class Source:
    """Where a source's text is, which of its documents count, and its weight in the mix."""

    name: str
    kind: str  # code, instruct or prose
    cap: int
    weight: float
    prompt: str | None = None
    response: str | None = None
    language: str | None = None
    is_code: bool = True


SOURCES = (
    Source("magicoder_oss", "instruct", 3_000, 0.040, "problem", "solution", "lang"),
    Source("codefeedback", "instruct", 3_000, 0.095, "query", "answer", "lang"),
    Source("magicoder_evol", "instruct", 3_000, 0.110, "instruction", "response"),
    Source("tinycodes", "instruct", 3_000, 0.115, "prompt", "response", "programming_language"),
    Source("glaive", "instruct", 3_000, 0.130, "question", "answer"),
    Source("codeparrot", "code", 20_000, 0.360, None, "content"),
    Source("cosmo", "prose", 8_000, 0.150, None, "text", is_code=False),
)
BY_NAME = {s.name: s for s in SOURCES}

PROSE_AUDIENCES_OUT = ("children", "young_children")
PROSE_FORMATS = ("e-learning_module", "scientific_article", "textbook", "textbook_academic", "textbook_narrative", "textbook_unconditionned_topic", "wikihow")
PYTHON_TAGS = ("", "py", "python", "python3")


@dataclass(frozen=True)
class Gates:
    """Bounds of the instruction cascade."""

    prompt: tuple[int, int] = (24, 1200)
    code: tuple[int, int] = (60, 2400)
    pair: int = 2000
    row: int = 3000
    per_source: int = 15_000
    leak: float = 0.7


@dataclass(frozen=True)
class Sentinels:
    eos: int
    prefix: int
    middle: int
    suffix: int


@dataclass(frozen=True)
class Words:
    """Tokens that a vocabulary begins with."""

    special: tuple[str, ...] = tuple(f"<|{w}|>" for w in "eos indent dedent fim_prefix fim_middle fim_suffix".split())
    locked: tuple[str, ...] = field(
        default=tuple("``` \n if else elif while for yield return continue break class def with lambda import as try from self except True None and False not or in is != == >= <= -= += ->".split(" "))
    )
