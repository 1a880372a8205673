"""Text as Column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop words.
STOP_WORDS = """
    a an the and or but in on at to for of with by from is are was were be been being have has had do does did
    will would could should may might can shall not no nor so if then than that this these those it its as into
    up out about over under also very just each all both few more most other some such only own same too well
    rather between during before after above below
""".split()


@F.pandas_udf(StringType())
def _nfkc(text):
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility normal form; ASCII text stays in the JVM's own expression."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def tokenize(text: Column, remove_stopwords: bool = True, normalize: bool = True) -> Column:
    """ASCII letter and digit runs of the lower-cased text, in order, with repeats."""
    text = F.coalesce(text, F.lit(""))
    tokens = F.regexp_extract_all(F.lower(nfkc(text) if normalize else text), F.lit("[a-z0-9]+"), F.lit(0))
    if not remove_stopwords:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


def weighted_text(fields: dict[str, Column], weights: dict[str, int]) -> Column:
    """Each field repeated by its weight, in the weights' order; empty fields and weights under 1 are left out."""
    parts = []
    for name, weight in weights.items():
        if weight > 0 and name in fields:
            value = fields[name]
            parts += [F.when(F.trim(F.coalesce(value, F.lit(""))) != "", value)] * weight
    return F.concat_ws(" ", *parts)


def word_ngrams(text: Column) -> Column:
    """Words of two letters or more, and their bigrams."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.concat(words, pairs)


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside blank-padded words; a word no longer than n is one n-gram, and larger n add none."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n):
        def grams(w):
            slide = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
            short = F.length(w) <= n
            first = F.lit(True) if n == low else F.length(w) > n - 1
            return F.when(short & ~first, F.expr("cast(array() as array<string>)")).when(short, F.array(w)).otherwise(slide)

        return F.flatten(F.transform(padded, grams))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def with_tokens(df: DataFrame, column: str) -> DataFrame:
    """Adds ``tokens`` of a text column; the value passes through a one-element ``explode``, so that no later filter or lambda plans it again."""
    return df.withColumn("tokens", F.explode(F.array(tokenize(F.col(column)))))
