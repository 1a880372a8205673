r"""Quality rules: line-first cleaning, then a document verdict (native).

Every line (split at ``\n``) is judged by punctuation, navigation and boilerplate rules; lines that
fail are removed, and a document goes if its base statistics fail or if the removed lines hold too
large a share of its word characters.  Everything is a projection of one row: no shuffle, no Python.

Defined results: a null or empty text has no words, so ``base_failed``; repeated rows stay repeated;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SYMBOLS = r"[#*$%&|<>]"
#: Separators of menus and breadcrumbs.
NAVIGATION = r"[|»›•·]"
#: Phrases that mark a line as boilerplate.
BOILERPLATE = (
    "cookie policy",
    "accept cookies",
    "we use cookies",
    "enable javascript",
    "javascript is disabled",
    "terms of use",
    "terms of service",
    "privacy policy",
    "click here",
    "read more",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "share on facebook",
    "share on twitter",
    "lorem ipsum",
)
#: Windows are hashed into 44 bits beside a position of 20 bits; more words take the exact path.
POSITION_BITS = 20


def line_fails(line: Column) -> Column:
    """Navigation (separators for a third of the words), symbols or shouting (for half), boilerplate."""
    words = F.regexp_count(line, F.lit(WORD))
    menu = F.regexp_count(line, F.lit(NAVIGATION))
    marks = F.regexp_count(line, F.lit(SYMBOLS))
    shouts = F.regexp_count(line, F.lit("!!"))
    phrase = F.lower(line).rlike("|".join(BOILERPLATE)) & (words <= 30)
    return ((menu >= 2) & (menu * 3 >= words)) | ((marks >= 3) & (marks * 2 >= words)) | ((shouts >= 2) & (shouts * 2 >= words)) | phrase


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "")).cast("bigint")


def covered(starts: Column) -> Column:
    """Words in the union of 3-word windows that start at these ascending positions."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(starts) - 1, F.lit(1))),
        F.lit(3).cast("bigint"),
        lambda total, k: total + F.coalesce(F.least(F.lit(3).cast("bigint"), F.get(starts, k.cast("int")) - F.get(starts, k.cast("int") - 1)), F.lit(0).cast("bigint")),
    )
    return F.when(F.size(starts) == 0, F.lit(0).cast("bigint")).otherwise(steps)


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows of ``words``: words in 3-word windows found twice or more.

    Windows become longs of hash and position, which sort as primitives; equal hashes are
    neighbours, and their words are compared, so a collision never counts.  A text with a
    collision, or too long for the position bits, takes the path that sorts the windows themselves.
    """
    df = df.withColumn(
        "keys",
        F.expr(
            f"case when n_words between 3 and {1 << POSITION_BITS} then sort_array(transform(sequence(0, cast(n_words as int) - 3), "
            f"i -> (xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)) & -{1 << POSITION_BITS}L) | i)) end"
        ),
    )
    mask = (1 << POSITION_BITS) - 1
    # pairs of neighbours with equal hash, as the index of the second
    df = df.withColumn(
        "pairs",
        F.expr(f"filter(sequence(1, greatest(size(keys) - 1, 1)), k -> shiftright(get(keys, k), {POSITION_BITS}) = shiftright(get(keys, k - 1), {POSITION_BITS}))"),
    )
    differ = " or ".join(f"get(words, cast(get(keys, k) & {mask}L as int) + {j}) != get(words, cast(get(keys, k - 1) & {mask}L as int) + {j})" for j in range(3))
    df = df.withColumn("exact", F.expr(f"(n_words > {1 << POSITION_BITS}) or coalesce(exists(pairs, k -> {differ}), false)"))
    fast = F.expr(f"sort_array(array_distinct(flatten(transform(pairs, k -> array(get(keys, k - 1) & {mask}L, get(keys, k) & {mask}L)))))")
    windows = F.expr(
        "array_sort(transform(sequence(0, cast(n_words as int) - 3), i -> struct(get(words, i) as a, get(words, i + 1) as b, get(words, i + 2) as c, cast(i as bigint) as i)))"
    )
    df = df.withColumn("windows", F.when(F.col("exact"), windows))
    same = "get(windows, {0}).a = get(windows, {1}).a and get(windows, {0}).b = get(windows, {1}).b and get(windows, {0}).c = get(windows, {1}).c"
    slow = F.expr(
        "sort_array(transform(filter(sequence(0, size(windows) - 1), k -> coalesce("
        + same.format("k", "k - 1") + ", false) or coalesce(" + same.format("k", "k + 1")
        + ", false)), k -> get(windows, k).i))"
    )
    df = df.withColumn("starts", F.when(F.col("n_words") < 3, F.expr("cast(array() as array<bigint>)")).when(F.col("exact"), slow).otherwise(fast))
    return df.withColumn("n_repeat_words", covered(F.col("starts"))).drop("keys", "pairs", "exact", "windows", "starts")


def judge(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_loss_pct: int = 50, with_text: bool = False
) -> DataFrame:
    """Statistics and verdict of every row; ``with_text`` adds ``clean_text``, the lines that passed.

    ``kept`` is false if ``base_failed`` (under ``min_words`` words, or over ``max_repeat_pct`` percent
    of them in repeated 3-word windows) or if failing lines hold over ``max_loss_pct`` percent of the
    word characters.
    """
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("n_words", F.size("words").cast("bigint"))
    df = df.withColumn("lines", F.split("text", "\n"))
    df = df.withColumn("full", F.filter("lines", lambda x: x.rlike(WORD)))
    df = df.withColumn("bad", F.filter("full", line_fails))
    df = with_repeats(
        df.withColumns(
            {
                "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
                "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint"),
                "n_dup_lines": (F.size("full") - F.size(F.array_distinct("full"))).cast("bigint"),
                "n_lines": F.size("lines").cast("bigint"),
                "n_bad_lines": F.size("bad").cast("bigint"),
                "bad_chars": word_chars(F.array_join("bad", "\n")),
            }
        )
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    lost = 100 * F.col("bad_chars") > max_loss_pct * F.col("word_chars")
    columns = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    columns += [failed.alias("base_failed"), (~failed & ~lost).alias("kept"), F.col("n_bad_lines"), F.col("bad_chars")]
    if with_text:
        columns.append(F.array_join(F.filter("lines", lambda x: ~x.rlike(WORD) | ~line_fails(x)), "\n").alias("clean_text"))
    return df.select(F.col("id").alias(id_col), *columns)
