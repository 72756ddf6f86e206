"""Metrics, schedules and the like as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS_PER_STEP = 8 * 2048 * 24


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased chance that one of k of a task's n samples, of which c pass, passes. Where fewer than k samples fail it is 1."""
    kept = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).when(c <= 0, F.lit(0.0)).otherwise(F.lit(1.0) - kept)


def cosine_rate(step: Column, base: float, least: float, warmup: int, decay: int) -> Column:
    """Linear to base, then along a cosine down to least."""
    done = (step - warmup) / F.lit(float(decay - warmup))
    falling = F.lit(least) + F.lit(0.5) * (F.lit(1.0) + F.cos(F.pi() * done)) * F.lit(base - least)
    return F.when(step < warmup, F.lit(base) * (step + 1) / F.lit(float(warmup + 1))).when(step > decay, F.lit(least)).otherwise(falling)


def constant_rate(step: Column, base: float, warmup: int) -> Column:
    return F.when(step < warmup, F.lit(base) * (step + 1) / F.lit(float(warmup + 1))).otherwise(F.lit(base))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def preference_margin(chosen: Column, rejected: Column, chosen_reference: Column, rejected_reference: Column, beta: float = 0.1) -> Column:
    return F.lit(beta) * (chosen - chosen_reference) - F.lit(beta) * (rejected - rejected_reference)


def preference_loss(margin: Column) -> Column:
    return softplus(-margin)


def masked_sum(values: Column, labels: Column, ignored: int = -1) -> Column:
    """The sum of the values whose label isn't the ignored one."""
    both = F.zip_with(values, labels, lambda v, y: F.when(y != ignored, v).otherwise(F.lit(0.0)))
    return F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x)


def tokens_at(iteration: Column) -> Column:
    return iteration.cast("bigint") * TOKENS_PER_STEP


def step_of(path: Column) -> Column:
    """The digits right before the checkpoint's extension, else null."""
    return F.nullif(F.regexp_extract(path, r"([0-9]+)\.pt", 1), F.lit("")).cast("bigint")


def iteration_of(path: Column) -> Column:
    """The first run of digits in the last part of the path, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"([0-9]+)", 1), F.lit("")).cast("bigint"), F.lit(0))


def clock(seconds: Column) -> Column:
    """h:mm:ss"""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint"), s % 60)


def fingerprint(*parts: Column) -> Column:
    """16 hexadecimal digits for whatever the parts are."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256), 1, 16)


def outcome_of(stderr: Column) -> Column:
    """(outcome, detail) by the exception named on the last line that isn't blank."""
    from corpuskit.functions.text import lines, strip

    kept = F.filter(lines(stderr), lambda ln: strip(ln) != "")
    last = F.coalesce(strip(F.try_element_at(kept, F.lit(-1))), F.lit(""))
    name = strip(F.substring_index(last, ":", 1))
    outcome = (
        F.when(name.isin("SyntaxError", "IndentationError", "TabError"), F.lit("SYNTAX_ERROR"))
        .when(name == "NameError", F.lit("NAME_ERROR"))
        .when(name == "AssertionError", F.lit("FAIL"))
        .otherwise(F.lit("ERROR"))
    )
    return F.struct(outcome.alias("outcome"), last.alias("detail"))


def decision(rft_yield: Column, pairs: Column, least_yield: float = 0.02, least_pairs: int = 300) -> Column:
    """Whether preference tuning is worth while: stop, defer or proceed."""
    return F.when(rft_yield < least_yield, "stop").when(pairs < least_pairs, "defer").otherwise("proceed")
