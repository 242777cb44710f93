"""Text expressions that several operators share. Null text counts as empty."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only; a text of one byte per code point has no other letters to spare."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and the controls 9 to 13."""
    return F.array_remove(F.split(text, GAP), "")


def windows(items: Column, count: Column, width: int, of) -> Column:
    """``of(first)`` for the 1-based first position of every window; none where there are fewer words."""
    return F.when(count >= width, F.transform(F.sequence(F.lit(1), count - (width - 1)), of)).otherwise(F.array())


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashed_sample(df: DataFrame, rows: int, total: int, *columns: str, spare: float = 2.0) -> DataFrame:
    """``rows`` rows in the order of a hash of ``columns``, out of about ``total``.

    Only rows whose hash lies in a small enough share of all hashes reach the final sort, so one task sorts
    about ``spare`` times the sample, however large ``df`` is.
    """
    mark, range_of = F.xxhash64(*[F.col(f"`{c}`") for c in columns]), 1 << 40
    share = min(1.0, spare * max(rows, 1000) / max(total, 1))
    near = df if share == 1.0 else df.filter(F.pmod(mark, F.lit(range_of)) < int(share * range_of))
    return near.orderBy(F.pmod(mark, F.lit(range_of)), *[F.col(f"`{c}`") for c in columns]).limit(rows)


def shielded(*roles: str) -> Callable:
    """For an operator on a frame and named columns of it: its other columns go through under names that nothing clashes with.

    ``roles`` are the arguments that name the columns the operator reads. A result whose name the input has already is
    lengthened by an underscore.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @wraps(operator)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            given = signature.bind(df, *args, **options)
            given.apply_defaults()
            used = {given.arguments[r] for r in roles}
            hidden = {c: f"~other{k}" for k, c in enumerate(df.columns) if c not in used}
            first = next(iter(given.arguments))
            given.arguments[first] = df.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in df.columns])
            out = operator(*given.args, **given.kwargs)
            shown = {v: k for k, v in hidden.items()}
            kept = df.select(*[F.col(f"`{c}`") for c in hidden])
            return out.select(*[F.col(f"`{c}`").alias(shown.get(c) or (c if c in used else free_name(kept, c))) for c in out.columns])

        return run

    return wrap
