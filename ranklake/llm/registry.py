"""The ``opN_<name>`` queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, html_text, near_dedup, quality_classifier, quality_rules, sharding, suffix_dedup, toxicity, url_filter
from .common import table

#: The rules of the URL query.
RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_shingles", "n_found").distinct()


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
}

#: Words and lines as the contracts see them, in the SQL's regular expressions.
SQL_WORD = r"[^\x20\x09-\x0D]+"
SQL_SYMBOLS = r"[#*$%&|<>]"


def sql_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def sql_line_fails(line: str) -> str:
    words, menu, marks, shouts = (sql_count(line, p) for p in (SQL_WORD, quality_rules.NAVIGATION, SQL_SYMBOLS, "!!"))
    phrase = f"(regexp_matches(lower({line}), '{'|'.join(quality_rules.BOILERPLATE)}') and {words} <= 30)"
    return f"(({menu} >= 2 and {menu} * 3 >= {words}) or ({marks} >= 3 and {marks} * 2 >= {words}) or ({shouts} >= 2 and {shouts} * 2 >= {words}) or {phrase})"


SQL_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
OP2_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+')"

ORACLE: dict[str, str] = {
    "op2_decontamination": f"""with i as (select item_id, {OP2_WORDS} w from benchmark), d as (select doc_id, {OP2_WORDS} w from documents),
ik as (select *, least(len(w), 5) k from i where len(w) > 0),
ig as (select distinct item_id, k, unnest(list_transform(range(0, len(w) - k + 1), lambda j: array_to_string(w[j + 1 : j + k], ' '))) g from ik),
n as (select item_id, count(*) n from ig group by all),
dg as (select distinct doc_id, k, unnest(list_transform(range(0, len(w) - k + 1), lambda j: array_to_string(w[j + 1 : j + k], ' '))) g from d, (select distinct k from ik) where len(w) >= k)
select doc_id, item_id, any_value(n)::bigint n_shingles, count(*) n_found from dg join ig using (k, g) join n using (item_id) group by doc_id, item_id having count(*) * 10 >= any_value(n) * 8""",
    "op8_url_filter": rf"""with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
r(h, p, v) as (values {SQL_RULES}),
m as (select page_id, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) v from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all)
select page_id, host, path, rule, coalesce(v, 'allow') verdict from u left join m using (page_id)""",
    "op9_quality_rules": rf"""with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{SQL_WORD}') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SQL_WORD}')) full_lines from documents),
b as (select *, list_filter(full_lines, lambda x: {sql_line_fails('x')}) bad from d),
g as (select doc_id, unnest(range(1, len(w) - 1)) i, w from d where len(w) >= 3),
h as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) c from g),
e as (select doc_id, count(distinct i + j) n from h, (select unnest([0, 1, 2]) j) where c > 1 group by all),
s as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, {sql_count('t', SQL_SYMBOLS)}::bigint n_symbols, (len(full_lines) - len(list_distinct(full_lines)))::bigint n_dup_lines,
 coalesce(n, 0)::bigint n_repeat_words, len(bad)::bigint n_bad_lines, length(array_to_string(regexp_extract_all(array_to_string(bad, chr(10)), '{SQL_WORD}'), ''))::bigint bad_chars from b left join e using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
 not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not 100 * bad_chars > 50 * word_chars kept, n_bad_lines, bad_chars from s""",
}
