"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia import policy

PYTHON_FLOAT = (
    r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)"
    r"(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity|nan)\s*$")
PYTHON_INT = r"^\s*[+-]?\d+(?:_\d+)*\s*$"
TOKEN = r"[A-Za-z][A-Za-z0-9]*|(?U)\d+(?:\.\d+)*"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def to_float(text: Column) -> Column:
    """Number from text; NULL when the text is not one (``1_000`` is, ``1.5f`` is not)."""
    # only text with one of these letters can be read differently by a plain cast
    careful = F.when(text.rlike(PYTHON_FLOAT),
                     F.regexp_replace(strip(text), "_", "").try_cast("double"))
    return F.when(text.rlike("[_dDfFxXpP]"), careful).otherwise(text.try_cast("double"))


def to_int(text: Column) -> Column:
    return F.when(text.rlike(PYTHON_INT),
                  F.regexp_replace(strip(text), "_", "").try_cast("int"))


def money(text: Column) -> Column:
    """First amount in the text, commas removed.

    The whole number is read: ``1500`` is 1500. (A pattern that stops at three
    digits where no comma follows would read 150.)
    """
    match = F.regexp_extract(text, r"\$?\s?(\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d{2})?|\d+(?:\.\d{2})?)", 1)
    return F.regexp_replace(match, ",", "").try_cast("double")


def parse_money(df: DataFrame, name: str) -> Column:
    """A numeric column as it is, a text column through ``money``."""
    if dict(df.dtypes)[name] == "string":
        return money(F.col(name))
    return F.col(name).cast("double")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def first_sentence(text: Column) -> Column:
    """Text before the first ``". "``, without its closing full stops."""
    return F.regexp_replace(F.substring_index(text, ". ", 1), r"\.+$", "")


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(policy.CITATION_PATTERN), F.lit(1))


def dates_quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(policy.DATE_PATTERN), F.lit(1))


def sentences(text: Column) -> Column:
    return F.split(text, policy.SENTENCE_PATTERN)


def expand_numbers(text: Column) -> Column:
    """Spell numbers both ways, phrase by phrase in their fixed order.

    One look-up decides whether the text has any of the phrases; the chain of
    replacements runs only on text that does.
    """
    phrases = [(f"(?U){pattern}", spelled) for pattern, spelled in policy.NUMBER_PHRASES]
    bare = [pattern.removeprefix(r"\b").removesuffix(r"\b")
            for pattern, _ in policy.NUMBER_PHRASES]
    any_phrase = rf"(?U)\b(?:{'|'.join(bare)})\b"
    spelled_out = reduce(
        lambda acc, p: F.regexp_replace(acc, p[0], p[1]), phrases, text)
    return F.when(text.rlike(any_phrase), spelled_out).otherwise(text)


def tokenize(text: Column) -> Column:
    """Retrieval terms in order, duplicates kept: they are the term frequencies."""
    words = F.regexp_extract_all(expand_numbers(F.lower(text)), F.lit(TOKEN), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(policy.STOP_WORDS))
    synonyms = F.create_map(*[
        part for term, others in policy.SYNONYMS.items()
        for part in (F.lit(term), F.array(*[F.lit(o) for o in others]))])
    none = F.array().cast("array<string>")

    def expand(word: Column) -> Column:
        return (
            F.when(word.isin(list(policy.SYNONYMS)),
                   F.concat(F.array(word), F.try_element_at(synonyms, word)))
            .when(word.contains("."), F.concat(
                F.array(word), F.filter(F.split(word, r"\."), lambda p: p != "")))
            .otherwise(F.concat(F.array(word), none)))

    return F.flatten(F.transform(kept, expand))


def model_text(narrative: Column, **tags: Column) -> Column:
    """Narrative plus ``__name_value`` marker words, blanks in values underscored."""
    parts = [F.concat(F.lit(f"__{name}_"), F.replace(value.cast("string"), F.lit(" "), F.lit("_")))
             for name, value in tags.items()]
    return F.concat_ws(" ", narrative, *parts)
