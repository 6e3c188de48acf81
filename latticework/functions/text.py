"""Text expressions that ingestion and analyses share. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about a framework's subject.
STOP_WORDS = (
    "the a an of in to for with and or is are be by on at as that this their they it its from how can use using used may will such but not do "
    "have has what which when between into about also than then there these those while each other both more most some many include including "
    "includes example examples based through"
).split()
#: More of them, for texts about work roles.
WORK_STOP_WORDS = [*STOP_WORDS, *"any all new one two three work perform performs ensure".split()]


def squish(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squished(df: DataFrame) -> DataFrame:
    """All string columns squished."""
    return df.withColumns({c: squish(F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"})


def slugify(text: Column) -> Column:
    """Lower case; parenthesised parts drop out; other characters become single dashes."""
    bare = F.regexp_replace(F.lower(text), r"\([^)]*\)", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def kebab(name: Column) -> Column:
    """CamelCase to camel-case."""
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1-$2"))


def snake_names(names: list[str]) -> list[str]:
    """Column names in lower case, other characters as single underscores; repeated ones numbered."""
    import re

    out: list[str] = []
    for name in names:
        base = re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "x"
        n = sum(o == base or re.fullmatch(re.escape(base) + r"_\d+", o) is not None for o in out)
        out.append(base if not n else f"{base}_{n + 1}")
    return out


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def first_present(df: DataFrame, *candidates: str) -> str | None:
    """The first candidate that the table has, else its first string column."""
    return next((c for c in candidates if c in df.columns), next((c for c, t in df.dtypes if t == "string"), None))


def tokens(text: Column, stop_words: list[str] | None = None, shortest: int = 3) -> Column:
    """The distinct lower-case ASCII words of a text, without stop words and short ones; null has none."""
    stop = STOP_WORDS if stop_words is None else stop_words
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= shortest) & ~w.isin(stop)))
