import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from ranklake.llm import quality_rules, registry, sharding, suffix_dedup, url_filter

EXTRA = [(90_000, None), (90_001, ""), (90_002, "a a a a a"), (90_003, "x y z w " * 30), (90_004, "#* <b>\n#* <b>\n \n")]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    passage = " ".join(f"p{i}" for i in range(60))
    planted = [(91_000, "before it " + passage + " after it"), (91_001, "others " + passage), (91_002, " ".join(passage.split()[:49]))]
    return [tuple(r) for r in docs.collect()] + EXTRA + planted


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"source": F.when(F.col("doc_id") % 3 > 0, "hot"), "id": F.lit(1), "n": F.lit(2)})


def test_sharding(docs, rows):
    got = sharding.shard(docs, rows_per_group=20).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t in rows}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    mixture = Counter((r.shard, r.source) for r in got)
    for source, n in Counter(r.source for r in got).items():
        assert all(abs(mixture[shard, source] - n / 24) < 2 for shard in range(24)), source
    assert sharding.shard(docs.limit(0)).count() == 0


def test_quality_statistics(docs, rows):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for key, text in rows:
        words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
        r = got[key]
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, key
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_line_rules(spark):
    """Rejected by lines: menus, symbols, shouting and boilerplate; words alone do not reject."""
    prose = " ".join(f"word{i}" for i in range(60))
    bad = ["Home | News | About", "#* <b> $ %", "Buy!! Now!! Cheap!!", "We use cookies to serve you"]
    rows = [(1, prose), (2, "\n".join([prose, *bad])), (3, "\n".join([f"w{i}" for i in range(40)] + [f"{x} {i}" for i, x in enumerate(bad * 8)])), (4, None), (5, prose + "\n" + prose)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=True).collect()}
    assert got[2].n_bad_lines == 4 and got[2].kept and got[2].clean_text == prose and got[1].kept and not got[1].n_bad_lines
    assert got[3].n_bad_lines == 32 and not got[3].kept and got[3].clean_text == "\n".join(f"w{i}" for i in range(40))
    assert not got[4].kept and got[5].n_dup_lines == 1 and got[5].base_failed


def test_exact_path_of_windows(spark, monkeypatch):
    """With few position bits every text takes the path that sorts the windows themselves."""
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect())] + [(90, "a b c a b c a"), (91, "a b"), (92, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(docs).collect()}
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 1)
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.judge(docs).collect()} == want and want[90] == 7


def test_repeated_passages(docs, rows, monkeypatch):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    places = defaultdict(list)
    for key, text in sorted(rows):
        words = re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(lower))
        for i in range(len(words) - 49):
            places[tuple(words[i : i + 50])].append((key, i))
    every, cut = defaultdict(set), defaultdict(set)
    for found in places.values():
        for n, (key, i) in enumerate(found):
            if len(found) > 1:
                every[key] |= set(range(i, i + 50))
                if n:
                    cut[key] |= set(range(i, i + 50))
    for tasks in (20_000, 50):  # one partition, and passages that span several
        monkeypatch.setattr(suffix_dedup, "SUFFIXES_PER_TASK", tasks)
        got = {r.doc_id: r for r in suffix_dedup.report(docs).collect()}
        assert {k: (r.n_repeat_words, r.n_cut_words) for k, r in got.items()} == {k: (len(every[k]), len(cut[k])) for k, _ in rows}
    clean = {r.doc_id: r for r in suffix_dedup.dedup(docs, length_col="n").collect()}
    assert clean[91_001].text == "others " and clean[91_001].n == 7 and clean[91_000].text == dict(rows)[91_000]
    assert clean[90_000].text is None and set(clean) == {k for k, _ in rows}


def test_repeated_passages_of_repeated_ids(spark):
    """Rows of one id with other texts are documents of their own; names of the operator's own columns may occur."""
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, "a " + passage), (1, "b c " + passage + " d"), (2, passage + " tail"), (None, passage), (2, "short"), (2, "short"), (3, None), (1, "a " + passage)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("all_starts", "cut_spans", "u", "t", "n_chars")})
    got = sorted(suffix_dedup.report(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words, r.n_cut_words))
    assert [(r.doc_id, r.n_words, r.n_repeat_words) for r in got] == [(1, 56, 56), (1, 56, 56), (1, 58, 55), (2, 1, 0), (2, 1, 0), (2, 56, 55), (3, 0, 0), (None, 55, 55)]
    assert sorted(r.n_cut_words for r in got if r.doc_id == 1) in ([0, 0, 55], [0, 55, 55]) and got[-1].n_cut_words == got[5].n_cut_words == 55
    assert suffix_dedup.dedup(docs).columns == docs.columns and suffix_dedup.dedup(docs).count() == len(rows)
    assert suffix_dedup.report(docs.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/x?q", "http://www.example.com/en/x", "https://b.net/es/", "https://b.net/fr", "http://net/fr/#x", "nothing", None, "", "http://", "http://xcom/", "ftp://q.com", "http://badexample.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    for most in (4_000_000, 1):
        got = {r.page_id: r for r in url_filter.filter_urls(pages, registry.RULES, max_keys=most).collect()}
        for i, url in enumerate(urls):
            match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
            host, path = (match.group(1).lower(), match.group(2)) if match else ("", "")
            fits = [r for r in registry.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
            best = max(fits, key=lambda r: len(r.key), default=None)
            want = (host, path, best.key if best else None, best.verdict if best else "allow")
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, url
