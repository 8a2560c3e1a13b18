"""Column expressions that read a column *name*: which metric it is and what it is per."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast import fixed
from tidecast.functions.cells import once, trimmed, without_controls


def column_name(header: Column, index: Column) -> Column:
    """Cleaned header cell, or a positional name. ``index`` counts the date column as 0."""
    given = without_controls(trimmed(header))
    unnamed = F.when(index == 1, F.lit("value")).otherwise(
        F.concat(F.lit("column"), (index + 1).cast("string"))
    )
    return F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(unnamed)


def without_qualifier(name: Column) -> Column:
    """Drop parenthesised parts; an unbalanced one takes the rest of the name along."""
    return F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", ""), r"\(.*$", "")


def fold_accents(text: Column) -> Column:
    folded = F.translate(text, fixed.ACCENTS_FROM, fixed.ACCENTS_TO)
    return reduce(
        lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), fixed.ACCENTS_LONG, folded
    )


def words(name: Column) -> Column:
    """A name as lowercase plain words with a blank on either side, for whole-word search."""
    low = fold_accents(F.lower(trimmed(without_qualifier(name))))
    plain = F.btrim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    return F.when(plain == "", F.lit("  ")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _any_word(text: Column, patterns: list[str]) -> Column:
    return text.rlike(" (" + "|".join(patterns) + ") ")


def _concept_of_words(w: Column) -> Column:
    return F.coalesce(*[F.when(_any_word(w, p), F.lit(c)) for c, _, _, p in fixed.CONCEPTS])


def plain_concept(name: Column) -> Column:
    """The first concept, in match order, that one of the name's words belongs to."""
    return once(words(name), _concept_of_words)


def concept(name: Column) -> Column:
    """The concept of a column name. ``A / B`` is a ratio when either side is a metric."""
    every = [p for _, _, _, patterns in fixed.CONCEPTS for p in patterns]

    def of_bare(bare: Column) -> Column:
        one_is_metric = F.exists(F.split(bare, "/"), lambda p: _any_word(words(p), every))
        return F.when(bare.contains("/") & one_is_metric, F.lit("ratio"))

    return F.coalesce(once(without_qualifier(name), of_bare), plain_concept(name))


def is_addable(concept_col: Column) -> Column:
    addable = [c for c, add, _, _ in fixed.CONCEPTS if add]
    return concept_col.isin(addable)


def _after_last_slash(name: Column) -> Column:
    return F.when(name.contains("/"), F.substring_index(name, "/", -1))


def _after_per(w: Column) -> Column:
    at = F.instr(w, " per ")
    return F.when(at > 0, F.substr(w, at + 4))


def rate_denominator(name: Column) -> Column:
    """The concept a rate is divided by, NULL when its name does not say."""

    def of_words(w: Column) -> Column:
        implied = [F.when(_any_word(w, p), F.lit(c)) for c, p in fixed.IMPLIED_DENOMINATORS]
        return F.coalesce(*implied, once(_after_per(w), _concept_of_words))

    return F.coalesce(plain_concept(_after_last_slash(name)), once(words(name), of_words))


def denominator_phrase(name: Column) -> Column:
    """The words a rate names as its denominator, empty for abbreviations."""
    after = _after_last_slash(without_qualifier(name))
    return F.coalesce(
        F.when(after.isNotNull(), F.btrim(words(after))),
        F.btrim(once(words(name), _after_per)),
        F.lit(""),
    )


def pattern_rank(name_words: Column, concept_col: Column) -> Column:
    """How canonical a name is for a concept: position of the first pattern it carries, if any."""
    patterns = F.create_map(
        *[x for c, _, _, p in fixed.CONCEPTS for x in (F.lit(c), F.array(*map(F.lit, p)))]
    )
    hits = F.transform(
        F.try_element_at(patterns, concept_col),
        lambda p: F.instr(name_words, F.concat(F.lit(" "), p, F.lit(" "))) > 0,
    )
    at = F.array_position(hits, True)
    return F.when(at > 0, (at - 1).cast("int"))


def canonical_count(concept_col: Column) -> Column:
    out = None
    for c, _, canon, _ in fixed.CONCEPTS:
        out = F.when(concept_col == c, canon) if out is None else out.when(concept_col == c, canon)
    return out.otherwise(0)


def is_identifier(name: Column) -> Column:
    """Judged by the last word, so that a bid is not taken for an id."""
    last = F.regexp_extract(F.lower(trimmed(name)), r"([^ _-]*)[ _-]*$", 1)
    return last.isin(fixed.IDENTIFIER_WORDS)


def _has_part(name: Column, parts: list[str]) -> Column:
    low = F.lower(trimmed(name))
    return reduce(lambda a, b: a | b, [low.contains(p) for p in parts])


def is_setting(name: Column) -> Column:
    return _has_part(name, fixed.SETTING_PARTS)


def is_ratio_name(name: Column) -> Column:
    return _has_part(name, fixed.RATIO_PARTS)


def same_name(a: Column, b: Column) -> Column:
    """Equality that ignores case and surrounding blanks."""
    return F.lower(trimmed(a)) == F.lower(trimmed(b))
