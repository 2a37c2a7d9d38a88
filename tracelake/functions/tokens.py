"""Splitting commands and scripts into tokens, and array helpers to read what stands next to what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, kinds: list[str]) -> Column:
    """The parts of a text that one of ``kinds`` (regular expressions without groups, tried in order) matches."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("|".join(kinds)), F.lit(0))


QUOTES = ['"[^"]*"', "'[^']*'"]


def words(command: Column) -> Column:
    """Quoted texts, separators of statements and line feeds, and words."""
    return tokens(command, [*QUOTES, r"[;&|\n\r]", r"[^\s;&|\"']+"])


def shell_tokens(command: Column) -> Column:
    """Quoted texts, variables, names with hyphens, line feeds and single signs."""
    return tokens(command, [*QUOTES, r"\$\w+", r"[\w-]+", r"[\n\r]", r"\S"])


def script_tokens(script: Column) -> Column:
    """JSON strings, names and single signs of a script."""
    return tokens(script, [r'"(?:\\[\s\S]|[^"\\])*"', r"[\w$]+", r"\S"])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what a lambda refers to from outside is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(array: Column, i: Column) -> Column:
    """Element ``i`` from 0; empty outside."""
    return F.coalesce(F.when(i >= 0, F.get(array, i)), F.lit(""))


def places(array: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Indexes from 0 of the elements for which ``test(element, index)`` holds."""
    return F.filter(F.transform(array, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def is_quoted(token: Column) -> Column:
    return (F.length(token) >= 2) & (token.startswith('"') | token.startswith("'"))


def inner(token: Column) -> Column:
    """A quoted token without its quotes; another one as it is."""
    return F.when(is_quoted(token), F.substr(token, F.lit(2), F.length(token) - 2)).otherwise(token)


def first_after(array: Column, i: Column, stop: Callable[[Column], Column], wanted: Callable[[Column], Column]) -> Column:
    """The first element behind ``i`` that is wanted, unless one that stops comes before; else null."""
    rest = F.slice(array, i + 2, F.greatest(F.size(array) - i - 1, F.lit(0)))
    return F.get(F.filter(rest, lambda x: stop(x) | wanted(x)), F.lit(0))
