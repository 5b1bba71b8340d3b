"""Column expressions on text shared by several operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed


#: Every character that Python's ``str.strip`` and ``str.split`` take for white space.
BLANKS = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(c, F.lit(BLANKS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also where ``use`` needs it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squeeze(c: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_field(c: Column) -> Column:
    """A field of a model record: no outer quotes, none of ``<>|/\\``, single blanks."""
    bare = F.regexp_replace(F.trim(strip(c), F.lit('"')), r"^'+|'+$", "")
    return squeeze(F.translate(bare, "<>|/\\", ""))


def normal_name(c: Column) -> Column:
    return F.lower(strip(c))


def bare_name(c: Column) -> Column:
    """Only ASCII letters and digits, lower case."""
    return F.lower(F.regexp_replace(c, r"[^a-zA-Z0-9]", ""))


def words(c: Column) -> Column:
    """White-space separated tokens; the default token definition of the package."""
    # Every blank to a plain one, then the split that needs no pattern: a quarter of the time of matching the tokens.
    return F.filter(F.split(F.translate(c, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def keyword_list(c: Column) -> Column:
    """Comma-separated keywords, trimmed, empties dropped, repeats dropped."""
    trimmed = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.array_distinct(F.filter(trimmed, lambda k: k != ""))


def clip(c: Column, chars: int, tail: str = "...") -> Column:
    """At most ``chars`` characters, marked with ``tail`` where something was cut."""
    return F.when(F.length(c) > chars, F.concat(F.left(c, F.lit(chars)), F.lit(tail))).otherwise(c)


def is_good_entity(name: Column, description: Column) -> Column:
    stop = fixed.ENTITY_STOP_WORDS_EN + fixed.ENTITY_STOP_WORDS_VI
    return (
        (F.length(name) >= 2)
        & ~normal_name(name).isin(stop)
        & ~strip(name).rlike(r"^\p{Nd}+$")
        & (F.length(strip(F.coalesce(description, F.lit("")))) >= 10)
        & name.rlike(r"[a-zA-Z0-9À-ỹ]")
    )


def joined_text(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    order: str,
    max_chars: int,
    name: str = "description",
    fold_case: bool = False,
    sep: str = "; ",
) -> DataFrame:
    """Per key: distinct texts in order of first appearance, joined, cut to ``max_chars``.

    The result never needs more than the first ``(max_chars + len(sep)) / (len(sep) + 1)``
    distinct texts (rounded up), each cut to ``max_chars``, so the group that meets in one task
    is bounded however large the key is: copies are merged before the shuffle and
    the rank limit is applied on both sides of it.
    """
    keys = list(keys)
    same = F.lower(F.col(text)) if fold_case else F.col(text)
    firsts = (
        df.where(F.col(text).isNotNull() & (F.col(text) != ""))
        .groupBy(*keys, same.alias("__same"))
        .agg(F.min(first_text(text, order, max_chars)).alias("__first"))
    )
    return join_firsts(firsts, keys, max_chars, name, sep)


def first_text(text: str, order: str, max_chars: int) -> Column:
    """What has to be known of a text's appearance; the minimum per distinct text is its first one."""
    return F.struct(F.col(order).alias("at"), F.left(F.col(text), F.lit(max_chars)).alias("text"))


def join_firsts(firsts: DataFrame, keys: Sequence[str], max_chars: int, name: str, sep: str = "; ") -> DataFrame:
    """Second half of ``joined_text``: from one row per key and distinct text (``__first``)."""
    # n texts of a character each, with separators between them, reach max_chars.
    needed = -(-(max_chars + len(sep)) // (len(sep) + 1))
    place = Window.partitionBy(*keys).orderBy("__first")
    return (
        firsts.select(*keys, "__first", F.row_number().over(place).alias("__rank"))
        .where(F.col("__rank") <= needed)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("__first")).alias("__texts"))
        .select(*keys, F.left(F.array_join(F.col("__texts.text"), sep), F.lit(max_chars)).alias(name))
    )
