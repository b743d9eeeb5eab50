"""Text columns: sentences, failure-mode classes and search tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.exprs import any_contains
from millwright.params import Lexicon, TokenRules


def split_sentences(c: Column) -> Column:
    """Trimmed non-empty sentences in order; a sentence ends at ``.``, ``!`` or ``?`` before white space."""
    # Splitting eats the white space between sentences, so only the ends of the whole text need trimming.
    text = F.coalesce(c, F.lit(""))
    # The pattern is tried at every character, so only texts with white space at an end are given to it.
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    trimmed = F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)
    return F.filter(F.split(trimmed, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def classify(c: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """First failure mode, in lexicon order, with a keyword in the text; NULL without a hit."""
    return classify_lower(F.lower(c), lexicon)


def classify_lower(low: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """:func:`classify` of a text in lower case already. ``low`` stands once per keyword, so it should be a column or a lambda's value."""
    chain = None
    for mode, words in lexicon.failure_modes:
        hit = any_contains(low, words)
        chain = F.when(hit, F.lit(mode)) if chain is None else chain.when(hit, F.lit(mode))
    return chain


def tokens(c: Column, rules: TokenRules = TokenRules()) -> Column:
    """Search tokens: lower-cased ASCII words, synonyms, one suffix stripped, stop words and single letters dropped."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]*"), F.lit(0))
    synonyms = F.create_map(*[F.lit(x) for pair in rules.synonyms.items() for x in pair])
    same = F.transform(words, lambda t: F.coalesce(synonyms[t], t))

    def strip(t):
        chain = None
        for suffix in rules.suffixes:
            fits = F.endswith(t, F.lit(suffix)) & (F.length(t) > len(suffix) + 3)
            cut = F.substring(t, F.lit(1), F.length(t) - len(suffix))
            chain = F.when(fits, cut) if chain is None else chain.when(fits, cut)
        return chain.otherwise(t)

    stems = F.transform(same, strip)
    return F.filter(stems, lambda t: (F.length(t) > 1) & ~t.isin(*rules.stop))
