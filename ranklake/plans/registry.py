"""Queries of the engine over the test tables, with their SQL.

Parts stand for items, customers for users, benchmark texts for search queries, documents for the
searched corpus; a view, click or purchase of ``events`` refers to part ``value`` modulo the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, with_tokens
from ..operators import checks, evaluation, judgements as rules, lsa, personalization, retrieval
from ..sources import reports, simulate
from ..sources.files import table
from ..sources.settings import Simulation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(nfc_normalize(coalesce({column}, ''))), '[a-z0-9]+'), lambda t: t not in ({STOPS}))"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def corpus(spark, sf_dir):
    docs = with_tokens(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"), "text").drop("text")
    queries = with_tokens(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text").drop("text")
    return docs, queries


def keyword(spark, sf_dir, k=20, b=0.75):
    return retrieval.bm25(*corpus(spark, sf_dir), k=k, b=b)


BM25 = f"""docs as (select doc_id item_id, {tokens_sql('text')} tokens from documents),
qs as (select item_id query_id, {tokens_sql('text')} tokens from benchmark),
post as (select item_id, len(tokens) dl, unnest(tokens) token from docs),
tf as (select item_id, token, any_value(dl) dl, count(*) tf from post group by all),
df as (select token, count(*) df from tf group by all),
st as (select count(*) n, avg(len(tokens)) avgdl from docs),
qt as (select query_id, token, count(*) qtf from (select query_id, unnest(tokens) token from qs) group by all),
"""


def bm25_sql(name: str, b: float, depth: int = 20) -> str:
    return f"""{name} as (select * from (select *, row_number() over (partition by query_id order by score desc, item_id) rank from (
  select query_id, item_id, round(sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.5::double / (tf + 1.5::double * (1 - {b}::double + {b}::double * dl / avgdl)))), 9) score
  from qt join tf using (token) join df using (token) cross join st group by all)) where rank <= {depth})"""


#: Candidates a channel hands to fusion; the fused list is cut afterwards.
DEPTH = 100

FUSED = f"""with {BM25}{bm25_sql('a', 0.75, DEPTH)}, {bm25_sql('s', 0.0, DEPTH)},
c as (select coalesce(a.query_id, s.query_id) query_id, coalesce(a.item_id, s.item_id) item_id, a.rank ar, a.score asc_, s.rank sr, s.score ssc
  from a full join s on a.query_id = s.query_id and a.item_id = s.item_id)
"""


@query(f"with {BM25}{bm25_sql('a', 0.75)} select query_id, item_id, rank, round(score, 6) score from a")
def bm25_search(spark, sf_dir):
    return keyword(spark, sf_dir).select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


@query(f"with t as (select unnest({tokens_sql('text')}) token from documents) select token, count(*) n from t group by all")
def token_counts(spark, sf_dir):
    return corpus(spark, sf_dir)[0].select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def channels(spark, sf_dir):
    """Both are BM25, so that SQL can follow: b = 0 stands in for the semantic channel, see ``hybrid_search``."""
    return keyword(spark, sf_dir, DEPTH), keyword(spark, sf_dir, DEPTH, b=0.0)


@query(FUSED + "select * from (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) rank from (select query_id, item_id, round(coalesce(1/(60::double+ar),0)+coalesce(1/(60::double+sr),0),9) score from c)) where rank <= 20")
def fusion_rrf(spark, sf_dir):
    return retrieval.fuse_rrf(retrieval.candidates(*channels(spark, sf_dir))).select("query_id", "item_id", "score", "rank")


@query(
    FUSED
    + """, n as (select *, min(asc_) over w alo, max(asc_) over w ahi, min(ssc) over w slo, max(ssc) over w shi from c window w as (partition by query_id)),
m as (select query_id, item_id, coalesce(case when asc_ is null then 0 when ahi=alo then 1 else (asc_-alo)/(ahi-alo) end,0)*0.5::double
  + coalesce(case when ssc is null then 0 when shi=slo then 1 else (ssc-slo)/(shi-slo) end,0)*0.5::double score from n)
select * from (select query_id, item_id, round(score,6) score, row_number() over (partition by query_id order by round(score,9) desc, item_id) rank from m) where rank <= 20"""
)
def fusion_linear(spark, sf_dir):
    return retrieval.fuse_linear(retrieval.candidates(*channels(spark, sf_dir))).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(
    FUSED
    + """, p as (select query_id, count(ar) a, count(sr) b, count(*) u, count(case when ar is not null and sr is not null then 1 end) o from c group by all),
j as (select coalesce(a,0) a, coalesce(b,0) b, coalesce(u,0) u, coalesce(o,0) o from qs left join p using (query_id))
select round(avg(a),2) avg_bm25, round(avg(b),2) avg_semantic, round(avg(u),2) avg_union, round(avg(o),2) avg_both, round(avg(case when u>0 then o::double/u else 0 end),4) mean_jaccard,
 count(case when a=0 then 1 end) empty_bm25, count(case when b=0 then 1 end) empty_semantic, count(case when a=0 and b>0 then 1 end) rescued_by_semantic from j"""
)
def fusion_diagnostics(spark, sf_dir):
    return retrieval.diagnostics(corpus(spark, sf_dir)[1], *channels(spark, sf_dir))


def judgements(spark, sf_dir):
    """Grade 1 to 3 by shared distinct tokens: a fifth, a half or nine tenths of the query's."""
    docs, queries = corpus(spark, sf_dir)
    size = queries.select("query_id", F.size(F.array_distinct("tokens")).alias("m"))
    wanted = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    shared = docs.select("item_id", F.explode(F.array_distinct("tokens")).alias("token")).join(wanted, "token").groupBy("query_id", "item_id").agg(F.count("*").alias("s"))
    grade = F.when(F.col("s") * 10 >= F.col("m") * 9, 3).when(F.col("s") * 2 >= F.col("m"), 2).when(F.col("s") * 5 >= F.col("m"), 1)
    return shared.join(size, "query_id").select("query_id", "item_id", grade.alias("grade")).filter("grade is not null")


QRELS = """qrels as (select * from (select query_id, item_id, case when s*10>=m*9 then 3 when s*2>=m then 2 when s*5>=m then 1 end grade from
 (select query_id, item_id, count(*) s from (select distinct item_id, token from post) join (select distinct query_id, token from qt) using (token) group by all)
 join (select query_id, len(list_distinct(tokens)) m from qs) using (query_id)) where grade is not null),
ks as (select unnest([5,10,20]) k),
q as (select *, row_number() over (partition by query_id order by grade desc, item_id) rn from qrels),
t as (select query_id, k, sum((pow(2,grade)-1)/log2(rn+1)) idcg from q, ks where rn<=k group by all),
n as (select query_id, count(*) rel from qrels group by all)"""


def metrics_sql(ranking: str) -> str:
    """Per query and cut-off, as ``e_<ranking>``."""
    return f"""r_{ranking} as (select a.query_id, a.rank, coalesce(grade,0) grade from {ranking} a left join qrels using (query_id, item_id)),
f_{ranking} as (select query_id, k, count(case when grade>=1 then 1 end) hits, min(case when grade>=1 then rank end) first, sum((pow(2,grade)-1)/log2(rank+1)) dcg from r_{ranking}, ks where rank<=k group by all),
e_{ranking} as (select qs.query_id, k, coalesce(hits,0)/k::double p, case when coalesce(rel,0)>0 then coalesce(hits,0)/rel::double else 0 end rc, coalesce(1/first::double,0) mrr,
  case when coalesce(idcg,0)>0 then coalesce(dcg,0)/idcg else 0 end nd, case when coalesce(hits,0)>0 then 1.0::double else 0 end hr
  from qs cross join ks left join f_{ranking} using (query_id,k) left join t using (query_id,k) left join n using (query_id))"""


@query(
    f"""with {BM25}{bm25_sql('a', 0.75)}, {QRELS}, {metrics_sql('a')}
select k, count(*) n_queries, round(avg(p),6) "precision", round(avg(rc),6) recall, round(avg(mrr),6) mrr, round(avg(nd),6) ndcg, round(avg(hr),6) hit_rate from e_a group by k"""
)
def ranking_metrics(spark, sf_dir):
    queries = corpus(spark, sf_dir)[1]
    return evaluation.macro_average(evaluation.evaluate(queries, keyword(spark, sf_dir), judgements(spark, sf_dir)))


def query_rows(ks: tuple[int, ...] = (5, 10, 20)) -> str:
    names = {"precision": "p", "recall": "rc", "mrr": "mrr", "ndcg": "nd"}
    return ", ".join(f"round(max(case when k={k} then {c} end),6) {n}_at_{k}" for k in ks for n, c in names.items())


@query(f"with {BM25}{bm25_sql('a', 0.75)}, {QRELS}, {metrics_sql('a')} select query_id, {query_rows()} from e_a group by all")
def query_metrics(spark, sf_dir):
    wide = reports.wide_metrics(evaluation.evaluate(corpus(spark, sf_dir)[1], keyword(spark, sf_dir), judgements(spark, sf_dir)))
    return wide.select("query_id", *(F.round(c, 6).alias(c) for c in wide.columns[1:]))


@query(
    f"""with {BM25}{bm25_sql('a', 0.75)}, {bm25_sql('s', 0.0)}, {QRELS}, {metrics_sql('a')}, {metrics_sql('s')},
m as (""" + " union all ".join(f"select '{x}' side, k, unnest(['precision','recall','mrr','ndcg']) metric, unnest([round(avg(p),6), round(avg(rc),6), round(avg(mrr),6), round(avg(nd),6)]) v from e_{x} group by k" for x in "as") + """)
select x.k, x.metric, x.v ours, y.v base, round(x.v - y.v, 6) delta from m x join m y on x.k = y.k and x.metric = y.metric where x.side = 'a' and y.side = 's'"""
)
def metric_deltas(spark, sf_dir):
    """BM25 against BM25 without length normalisation."""
    queries, judged = corpus(spark, sf_dir)[1], judgements(spark, sf_dir)
    ours, base = (evaluation.macro_average(evaluation.evaluate(queries, keyword(spark, sf_dir, b=b), judged)) for b in (0.75, 0.0))
    return reports.deltas(ours, base)


@query(f"""with {BM25}{bm25_sql('a', 0.75)}, {QRELS}
select a.query_id, text query_text, rank, a.item_id, printf('%.6f', round(score, 6)) bm25_score, coalesce(grade, 0) relevance_grade from a join benchmark b on b.item_id = a.query_id left join qrels on qrels.query_id = a.query_id and qrels.item_id = a.item_id""")
def search_results(spark, sf_dir):
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return reports.shown_results(keyword(spark, sf_dir), texts, judgements(spark, sf_dir))


@query(
    """with q as (select vec_id query_id, embedding q from embeddings where vec_id % 100 = 0)
select query_id, item_id, rank from (select query_id, vec_id item_id, row_number() over (partition by query_id order by s desc, vec_id) rank from
(select query_id, vec_id, round(list_inner_product(q::double[], embedding::double[]) / sqrt(list_inner_product(q::double[],q::double[])) / sqrt(list_inner_product(embedding::double[],embedding::double[])), 9) s from q, embeddings)) where rank <= 20"""
)
def dense_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    queries = vectors.filter("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    return retrieval.cosine_search(vectors, queries).select("query_id", "item_id", "rank")


def catalogue(spark, sf_dir):
    """Parts as texts, and each name among them as a query."""
    part = table(spark, sf_dir, "part")
    items = part.select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return items, part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()


@query(
    r"""with d as (select p_partkey item_id, lower(concat_ws(' ', p_name, p_type, p_brand)) t from part),
w as (select item_id, regexp_extract_all(t, '\b\w\w+\b') ws from d),
c as (select item_id, ' ' || unnest(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) || ' ' p from d),
g as (select item_id, 'w:' || unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) feature from w
 union all select item_id, 'c:' || substr(p, i, k) from (select item_id, p, k, unnest(range(1, length(p) - k + 2)) i from c, (select unnest([3, 4, 5]) k) where length(p) >= k)),
tf as (select item_id, feature, count(*) tf from g group by all), df as (select feature, count(*) df from tf group by all)
select item_id, feature, round((case when feature like 'w:%' then 1::double else 0.5::double end) * (1 + ln(tf)) * (ln((1 + (select count(*) from part)) / (1 + df)::double) + 1), 6) weight from tf join df using (feature)"""
)
def tfidf_weights(spark, sf_dir):
    return lsa.tfidf(catalogue(spark, sf_dir)[0])[0].select("item_id", "feature", F.round("w", 6).alias("weight"))


def semantic(spark, sf_dir, k):
    items, queries = catalogue(spark, sf_dir)
    model = lsa.fit(items)
    return lsa.search(model, lsa.transform(model, items), queries, k)


def lsa_search(spark, sf_dir):
    """SQL has no SVD; a test holds it against a dense one."""
    return semantic(spark, sf_dir, 20)


def hybrid_search(spark, sf_dir):
    """BM25 and latent-semantic candidates, fused by reciprocal ranks."""
    items, queries = (with_tokens(df, "text").drop("text") for df in catalogue(spark, sf_dir))
    return retrieval.fuse_rrf(retrieval.candidates(retrieval.bm25(items, queries, k=DEPTH), semantic(spark, sf_dir, DEPTH))).select("query_id", "item_id", "score", "rank")


QUERIES |= {"lsa_search": lsa_search, "hybrid_search": hybrid_search}


def behaviour(spark, sf_dir):
    """Events with a session per user and day, and the part each refers to."""
    n = table(spark, sf_dir, "part").count()
    events = table(spark, sf_dir, "events").withColumn("session_id", F.date_format("ts", "yyyy-MM-dd"))
    return events.withColumn("item_id", (F.pmod(F.col("event_id"), F.lit(n)) + 1).cast("bigint"))


EVENTS = "ev as (select *, strftime(ts, '%Y-%m-%d') session_id, event_id % (select count(*) from part) + 1 item_id from events)"
SPLIT = f"""{EVENTS}, ss as (select user_id, session_id, min(ts) start_ from ev group by all),
sp as (select user_id, session_id, case when i > n - (case when n>=2 then greatest(1, floor(n*(1.0::double-0.8::double))) else 0 end) then 'test' else 'train' end split
 from (select *, row_number() over (partition by user_id order by start_, session_id) i, count(*) over (partition by user_id) n from ss))"""


@query(f"with {SPLIT} select user_id, session_id, split from sp")
def session_split(spark, sf_dir):
    return personalization.sessions_split(behaviour(spark, sf_dir)).select("user_id", "session_id", "split")


WEIGHTS = {"click": 1.0, "purchase": 4.0}
POSITIVE = f"""{SPLIT}, tr as (select ev.* from ev join sp using (user_id, session_id) where split = 'train'),
po as (select *, (case event_type when 'click' then 1.0::double else 4.0::double end) * pow(0.5::double, (epoch_us((select max(ts) from tr)) - epoch_us(ts)) / 86400e6::double / 30::double) eff from tr where event_type in ('click','purchase'))"""


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))


def training(spark, sf_dir):
    events = behaviour(spark, sf_dir)
    train = events.join(personalization.sessions_split(events).filter("split = 'train'").select("user_id", "session_id"), ["user_id", "session_id"])
    return train, personalization.effective(train, WEIGHTS, 30.0)


@query(
    f"""with {POSITIVE}, d as (select user_id, 'category' dim, p_type "value", sum(eff) s from po join part on p_partkey = item_id group by all
 union all select user_id, 'brand', p_brand, sum(eff) from po join part on p_partkey = item_id group by all)
select user_id, dim, "value", round(s / sum(s) over (partition by user_id, dim), 6) weight from d"""
)
def user_affinities(spark, sf_dir):
    _, positive = training(spark, sf_dir)
    return personalization.affinities(positive, parts(spark, sf_dir), ("category", "brand")).withColumn("weight", F.round("weight", 6))


@query(
    f"""with {POSITIVE}, s as (select user_id, count(*) n_events from tr group by all),
l as (select user_id, count(*) n_positive, sum(ln(p_retailprice)*eff)/sum(eff) m from po join part on p_partkey=item_id group by all),
u as (select c_custkey user_id, c_acctbal < 0 cold from customer)
select user_id, coalesce(n_events,0) n_events, coalesce(n_positive,0) n_positive, round(m,6) mean_log_price,
 case when coalesce(n_positive,0)>0 then 'warm' when coalesce(cold,false) then 'cold_start' when coalesce(n_events,0)>0 then 'no_positive' else 'no_history' end status
from u full join s using (user_id) left join l using (user_id)"""
)
def user_profiles(spark, sf_dir):
    train, positive = training(spark, sf_dir)
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("is_cold_start"))
    return personalization.profiles(train, positive, parts(spark, sf_dir), users)


@query(
    """select name, n_bad, n_bad = 0 passed from (
select 'orders.pk' name, count(*) n_bad from (select o_orderkey from orders group by all having count(*)>1)
union all select 'lineitem.pk', count(*) from (select l_orderkey, l_linenumber from lineitem group by all having count(*)>1)
union all select 'lineitem.part', count(distinct l_partkey) from lineitem where l_partkey not in (select p_partkey from part)
union all select 'orders.customer', count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer)
union all select 'events.type', count(*) from events where event_type is null or event_type not in ('view','click','signup','purchase')
union all select 'lineitem.discount', count(*) from lineitem where l_discount is null or l_discount<0 or l_discount>0.05
union all select 'documents.text', count(*) from documents where trim(coalesce(text,''))='')"""
)
def quality_report(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "part", "customer", "events", "documents")}
    return checks.report(
        [
            checks.unique("orders.pk", t["orders"], "o_orderkey"),
            checks.unique("lineitem.pk", t["lineitem"], "l_orderkey", "l_linenumber"),
            checks.references("lineitem.part", t["lineitem"], "l_partkey", t["part"], "p_partkey"),
            checks.references("orders.customer", t["orders"], "o_custkey", t["customer"], "c_custkey"),
            checks.members("events.type", t["events"], "event_type", ["view", "click", "signup", "purchase"]),
            checks.between("lineitem.discount", t["lineitem"], "l_discount", 0.0, 0.05),
            checks.required("documents.text", t["documents"], "text"),
        ]
    )


@query(
    """select a n_shown, b n_clicked, c n_bought, round(case when a=0 then 0 else b/a::double end,6) ctr, round(case when b=0 then 0 else c/b::double end,6) conversion
from (select count(case when event_type='view' then 1 end) a, count(case when event_type='click' then 1 end) b, count(case when event_type='purchase' then 1 end) c from events)"""
)
def event_funnel(spark, sf_dir):
    return checks.funnel(table(spark, sf_dir, "events"), "view", "click", "purchase")


RESULTS = """rs as (select * from (select p_size query_id, p_partkey item_id, p_retailprice score, row_number() over (partition by p_size order by p_retailprice desc, p_partkey) rank from part) where rank <= 100)"""
REQUESTS = f"""with {POSITIVE}, te as (select ev.*, ev.user_id::varchar || ':' || session_id request_id, p_size query_id from ev join sp using (user_id, session_id) join part on p_partkey = item_id where split = 'test'),
gr as (select request_id, item_id, max(case event_type when 'click' then 1 else 4 end) grade from te where event_type in ('click','purchase') group by all),
se as (select user_id, count(*) n_events from tr group by all),
li as (select user_id, count(*) n_positive, round(sum(ln(p_retailprice)*eff)/sum(eff),6) m from po join part on p_partkey=item_id group by all),
pr as (select user_id, m, case when coalesce(n_positive,0)>0 then 'warm' when coalesce(cold,false) then 'cold_start' when coalesce(n_events,0)>0 then 'no_positive' else 'no_history' end status
 from (select c_custkey user_id, c_acctbal < 0 cold from customer) full join se using (user_id) left join li using (user_id)),
fi as (select request_id, arg_min(user_id, (ts, event_id)) user_id, arg_min(query_id, (ts, event_id)) query_id from te group by all),
rq as (select fi.request_id, fi.user_id, fi.query_id, coalesce(pr.status, 'no_history') status from fi left join pr using (user_id) where request_id in (select request_id from gr)),
{RESULTS}"""
RANKED = f"""{REQUESTS},
af as (select user_id, dim, v, round(s / sum(s) over (partition by user_id, dim), 9) w from (select user_id, 'category' dim, p_type v, sum(eff) s from po join part on p_partkey = item_id group by all
 union all select user_id, 'brand', p_brand, sum(eff) from po join part on p_partkey = item_id group by all)),
ca as (select request_id, user_id, item_id, rank original_rank, case when max(score) over w = min(score) over w then 1 else (score - min(score) over w) / (max(score) over w - min(score) over w) end norm
 from rq join rs using (query_id) window w as (partition by request_id)),
fs as (select ca.*, round(case when status = 'warm' then norm*0.7::double/1.0::double + coalesce(c.w,0)*0.15::double + coalesce(b.w,0)*0.09::double + coalesce(exp(-abs(ln(p_retailprice) - m)/0.5::double),0)*0.06::double else norm end, 9) final_score
 from ca join part on p_partkey = item_id left join pr using (user_id) left join af c on c.user_id = ca.user_id and c.dim = 'category' and c.v = p_type left join af b on b.user_id = ca.user_id and b.dim = 'brand' and b.v = p_brand),
rk as (select * from (select request_id, user_id, item_id, original_rank, row_number() over (partition by request_id order by final_score desc, original_rank, item_id) rank, final_score from fs) where rank <= 20)"""
MIX = {"retrieval": 0.7, "category": 0.15, "brand": 0.09, "price": 0.06}


def requests(spark, sf_dir):
    """Test sessions stand for requests; each asks for the size of the first part that it touches, and the dearest 100 parts of a size are its candidates."""
    events, part = behaviour(spark, sf_dir), table(spark, sf_dir, "part")
    train, positive = training(spark, sf_dir)
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("is_cold_start"))
    profile = personalization.profiles(train, positive, parts(spark, sf_dir), users)
    test = events.join(personalization.sessions_split(events).filter("split = 'test'").select("user_id", "session_id"), ["user_id", "session_id"])
    test = test.withColumn("request_id", F.concat_ws(":", F.col("user_id").cast("string"), "session_id"))
    test = test.join(part.select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("query_id")), "item_id")
    results = retrieval.top_k(part.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("score")), 100)
    return personalization.build_requests(test, profile), personalization.request_grades(test), results, profile, positive


def ranked_requests(spark, sf_dir):
    asked, grades, results, profile, positive = requests(spark, sf_dir)
    prefs = personalization.affinities(positive, parts(spark, sf_dir), ("category", "brand"))
    return asked, grades, results, personalization.personalize(asked, results, parts(spark, sf_dir), prefs, profile, MIX)


@query(f"{REQUESTS} select * from rq")
def test_requests(spark, sf_dir):
    return requests(spark, sf_dir)[0]


@query(f"{RANKED} select request_id, user_id, item_id, original_rank, rank, round(final_score, 6) final_score from rk")
def personalized_search(spark, sf_dir):
    return ranked_requests(spark, sf_dir)[3].withColumn("final_score", F.round("final_score", 6))


@query(
    f"""{REQUESTS}, ps as (select rq.request_id, status, gr.item_id, case when rs.item_id is not null then 1 else 0 end hit from rq join gr using (request_id) left join rs on rs.query_id = rq.query_id and rs.item_id = gr.item_id),
pq as (select request_id, any_value(status) status, count(*) n, sum(hit) hit from ps group by all)
select count(*) n_requests, count(case when hit>0 then 1 end) n_covered, round(count(case when hit>0 then 1 end)/count(*)::double,6) request_coverage, sum(n)::bigint n_positives, round(sum(hit)/sum(n)::double,6) item_coverage,
 count(case when status='warm' then 1 end) n_warm, round(case when count(case when status='warm' then 1 end)=0 then 0 else count(case when status='warm' and hit>0 then 1 end)/count(case when status='warm' then 1 end)::double end,6) warm_coverage from pq"""
)
def candidate_coverage(spark, sf_dir):
    asked, grades, results, _, _ = requests(spark, sf_dir)
    return evaluation.candidate_coverage(asked, asked.join(results, "query_id").select("request_id", "item_id"), grades)


@query(
    f"""{RANKED}, s as (select request_id, min(case when rank = original_rank then 1 else 0 end) same from rk group by all)
select status, count(*) n_requests, count(distinct user_id) n_users, round(coalesce(avg(same),1),6) same_order from rq left join s using (request_id) group by all"""
)
def fallback_statistics(spark, sf_dir):
    asked, _, _, ranked = ranked_requests(spark, sf_dir)
    return personalization.fallback_statistics(asked, ranked)


@query(
    f"""{RANKED}, ks as (select unnest([5,10,20]) k),
j as (select rk.request_id, rank, coalesce(grade,0) grade from rk left join gr using (request_id, item_id)),
f as (select request_id, k, count(case when grade>=1 then 1 end) hits, min(case when grade>=1 then rank end) first, sum((pow(2,grade)-1)/log2(rank+1)) dcg from j, ks where rank<=k group by all),
i as (select request_id, k, sum((pow(2,grade)-1)/log2(rn+1)) idcg from (select *, row_number() over (partition by request_id order by grade desc, item_id) rn from gr), ks where rn<=k group by all),
n as (select request_id, count(*) rel from gr group by all),
e as (select k, coalesce(hits,0)/k::double p, coalesce(hits,0)/rel::double rc, coalesce(1/first::double,0) mrr, coalesce(dcg,0)/idcg nd, case when coalesce(hits,0)>0 then 1.0::double else 0 end hr
 from rq cross join ks left join f using (request_id,k) left join i using (request_id,k) left join n using (request_id))
select k, count(*) n_queries, round(avg(p),6) "precision", round(avg(rc),6) recall, round(avg(mrr),6) mrr, round(avg(nd),6) ndcg, round(avg(hr),6) hit_rate from e group by k"""
)
def behaviour_metrics(spark, sf_dir):
    asked, grades, _, ranked = ranked_requests(spark, sf_dir)
    return evaluation.macro_average(evaluation.behaviour_metrics(asked, ranked, grades))


@query(f"with {BM25}{bm25_sql('a', 0.75)}, h as (select distinct query_id, 1 found from a) select count(*) n_queries, count(case when found is null then 1 end) n_empty, round(avg(coalesce(found,0)::double),6) coverage from qs left join h using (query_id)")
def query_coverage(spark, sf_dir):
    return evaluation.query_coverage(corpus(spark, sf_dir)[1], keyword(spark, sf_dir))


CHAIN = f"""with {EVENTS}, ch as (select *, max(case when event_type='view' then 1 else 0 end) over w v, max(case when event_type='click' then 1 else 0 end) over w c
 from ev window w as (partition by user_id, session_id order by ts, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 4 else 99 end, event_id rows between unbounded preceding and 1 preceding))"""


@query(f"{CHAIN} select event_id, event_type, user_id, session_id from ch where (event_type='click' and coalesce(v,0)=0) or (event_type='purchase' and coalesce(c,0)=0)")
def event_dependency_violations(spark, sf_dir):
    found = checks.event_chains(behaviour(spark, sf_dir), {"view": 0, "click": 1, "purchase": 4}, {"click": "view", "purchase": "click"}, ("user_id", "session_id"))
    return found.select("event_id", "event_type", "user_id", "session_id")


@query(
    f"""with {EVENTS}, p as (select *, row_number() over (partition by user_id, session_id order by ts, event_id) position from ev)
select case when position <= 5 then 'top' when position between 15 and 20 then 'bottom' end bucket, count(case when event_type='view' then 1 end) n_shown, count(case when event_type='click' then 1 end) n_clicked,
 round(case when count(case when event_type='view' then 1 end)=0 then 0 else count(case when event_type='click' then 1 end)/count(case when event_type='view' then 1 end)::double end,6) ctr from p where position <= 5 or position between 15 and 20 group by 1"""
)
def ctr_by_position(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id", "session_id").orderBy("ts", "event_id"))
    events = behaviour(spark, sf_dir).withColumn("position", place)
    return checks.click_rate(events, F.when(F.col("position") <= 5, "top").when(F.col("position").between(15, 20), "bottom"))


@query("select event_type, count(*) n, count(distinct user_id) n_users from events group by all")
def event_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels")


@query(" union all ".join(f"select '{t}' name, count(*) n_rows from {t}" for t in TABLES))
def table_statistics(spark, sf_dir):
    return reduce(DataFrame.unionByName, (table(spark, sf_dir, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("name"), "n_rows") for t in TABLES))


@query(
    f"""with {EVENTS}, r as (
select 'events.rows' name, case when count(*) between 1 and 1000000000 then 0 else 1 end n_bad from events
union all select 'customer.orders', count(*) from customer where c_custkey not in (select o_custkey from orders)
union all select 'part.sold', count(*) from part where p_partkey not in (select l_partkey from lineitem)
union all select 'session.clicks', count(*) from (select user_id, session_id from ev where event_type='click' group by all having count(*)>3)
union all select 'purchase.value', count(*) from events where event_type='purchase' and value < 1
union all select 'events.time', count(*) from events where ts is null
union all select 'benchmark.judged', count(*) from benchmark where item_id not in (select doc_id from labels))
select name, n_bad, n_bad=0 passed, case when n_bad=0 then 'pass' when name in ('customer.orders','part.sold','benchmark.judged') then 'warning' else 'error' end level from r"""
)
def validation_report(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("events", "customer", "orders", "part", "lineitem", "benchmark", "labels")}
    clicks = behaviour(spark, sf_dir).filter("event_type = 'click'").groupBy("user_id", "session_id").agg(F.count("*").alias("m")).filter("m > 3")
    rows = [
        checks.row_count("events.rows", t["events"], 1, 1_000_000_000),
        checks.references("customer.orders", t["customer"], "c_custkey", t["orders"], "o_custkey"),
        checks.references("part.sold", t["part"], "p_partkey", t["lineitem"], "l_partkey"),
        checks.check("session.clicks", clicks),
        checks.bounded_where("purchase.value", t["events"], "value", F.col("event_type") == "purchase", 1.0),
        checks.utc("events.time", t["events"].select(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("ts")), "ts"),
        checks.references("benchmark.judged", t["benchmark"], "item_id", t["labels"], "doc_id"),
    ]
    return checks.levelled(checks.report(rows), ["customer.orders", "part.sold", "benchmark.judged"])


SHOP = """i as (select p_partkey item_id, p_type category, p_name subcategory, p_brand brand, list_distinct(string_split(lower(p_name || ' ' || p_brand), ' ')) tw, list_distinct(string_split(lower(p_type || ' ' || p_name || ' of size ' || p_size), ' ')) dw from part),
q as (select *, list_distinct(string_split(lower(query_text), ' ')) qw, list_distinct(string_split(lower(intent), ' ')) iw from (
 select p_brand || ':' || p_type query_id, p_brand || ' ' || min(p_name) query_text, p_type intended, p_type || ' of size ' || min(p_size) intent from part group by p_brand, p_type
 union all select distinct p_type, 'anything widget', p_type, 'nothing' from part)),
r as (select query_id, item_id, category = intended same, len(list_intersect(qw, tw)) shared,
 (category = intended)::int + contains(lower(query_text), lower(subcategory))::int + contains(lower(query_text), lower(brand))::int + (len(list_intersect(qw, tw)) >= 2)::int + (len(list_intersect(iw, dw)) >= 3)::int score from q, i)"""


@query(
    f"""with {SHOP}, w as (select query_id from r group by all having max(score) < 2 and max(same::int) = 1)
select query_id, item_id, least(score, 3) grade from r where score > 0 union all
select query_id, item_id, 2 from (select *, row_number() over (partition by query_id order by same desc, shared desc, item_id) n from r where score = 0 and query_id in (from w)) where n = 1"""
)
def rule_judgements(spark, sf_dir):
    """Parts as items, their brands and types as queries; a query of one type that names nothing falls back."""
    part = table(spark, sf_dir, "part")
    items = part.select(
        F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category"), F.col("p_name").alias("subcategory"), F.col("p_brand").alias("brand"),
        F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.concat_ws(" ", "p_type", "p_name", F.lit("of size"), F.col("p_size").cast("string")).alias("description"),
    )
    named = part.groupBy("p_brand", "p_type").agg(F.min("p_name").alias("name"), F.min("p_size").alias("size")).select(
        F.concat_ws(":", "p_brand", "p_type").alias("query_id"), F.concat_ws(" ", "p_brand", "name").alias("query_text"), F.col("p_type").alias("intended_category"),
        F.concat_ws(" ", "p_type", F.lit("of size"), F.col("size").cast("string")).alias("semantic_intent"),
    )
    plain = part.select("p_type").distinct().select(F.col("p_type").alias("query_id"), F.lit("anything widget").alias("query_text"), F.col("p_type").alias("intended_category"), F.lit("nothing").alias("semantic_intent"))
    return rules.grade(items, named.unionByName(plain))


@query(
    f"""with {EVENTS}, b as (select event_type, case when coalesce(p_type = case when c_nationkey % 2 = 0 then 'ECONOMY' else 'PROMO' end, false) then 'preferred' else 'other' end bucket
 from ev left join part on p_partkey = item_id left join customer on c_custkey = user_id)
select bucket, count(case when event_type='view' then 1 end) n_shown, count(case when event_type='click' then 1 end) n_clicked,
 round(case when count(case when event_type='view' then 1 end)=0 then 0 else count(case when event_type='click' then 1 end)/count(case when event_type='view' then 1 end)::double end,6) ctr from b group by bucket"""
)
def ctr_by_preference(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.array(F.when(F.col("c_nationkey") % 2 == 0, "ECONOMY").otherwise("PROMO")).alias("preferred_categories"))
    return checks.preference_rate(behaviour(spark, sf_dir), parts(spark, sf_dir), users)


@query(
    f"""with {EVENTS}, b as (select event_type, case when p_size/50::double >= 0.7::double then 'high' when p_size/50::double < 0.4::double then 'low' end bucket from ev join part on p_partkey = item_id)
select bucket, count(case when event_type='click' then 1 end) n_clicked, count(case when event_type='purchase' then 1 end) n_bought,
 round(case when count(case when event_type='click' then 1 end)=0 then 0 else count(case when event_type='purchase' then 1 end)/count(case when event_type='click' then 1 end)::double end,6) conversion from b where bucket is not null group by bucket"""
)
def conversion_by_quality(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_size") / 50.0).alias("quality_score"))
    return checks.quality_conversion(behaviour(spark, sf_dir), items)


@query(
    f"""{RANKED}, ks as (select unnest([5,10,20]) k), x as (select 'a' side, request_id, item_id, rank from rk union all select 'b', request_id, item_id, rank from rq join rs using (query_id) where rank <= 20),
f as (select side, request_id, k, sum((pow(2,grade)-1)/log2(rank+1)) dcg from x join gr using (request_id, item_id), ks where rank<=k group by all),
i as (select request_id, k, sum((pow(2,grade)-1)/log2(rn+1)) idcg from (select *, row_number() over (partition by request_id order by grade desc, item_id) rn from gr), ks where rn<=k group by all),
v as (select rq.*, k, coalesce(a.dcg,0)/idcg a, coalesce(b.dcg,0)/idcg b from rq cross join ks join i using (request_id, k) left join f a on a.side='a' and a.request_id=rq.request_id and a.k=ks.k left join f b on b.side='b' and b.request_id=rq.request_id and b.k=ks.k)
select request_id, user_id, query_id, status, """
    + ", ".join(f"printf('%.6f', round(max(case when k={k} then {c} end),6)) {n}" for k in (5, 10, 20) for c, n in (("b", f"baseline_behavior_ndcg_at_{k}"), ("a", f"personalized_behavior_ndcg_at_{k}"), ("a - b", f"behavior_ndcg_at_{k}_delta")))
    + " from v group by all"
)
def request_metrics(spark, sf_dir):
    asked, grades, results, ranked = ranked_requests(spark, sf_dir)
    base = asked.join(results.filter("rank <= 20"), "query_id").select("request_id", "item_id", "rank")
    ours, before = (evaluation.behaviour_metrics(asked, df, grades) for df in (ranked, base))
    return reports.request_rows(asked, ours, before)


#: A small shop of its own: the simulator takes nothing from the tables.
TOYS = Simulation(
    seed=11, num_items=3000, num_users=400, num_queries=300, num_sessions=4000, categories=["Garden", "Kitchen", "Office"],
    subcategories={"Garden": ["Rakes", "Pots"], "Kitchen": ["Pans", "Knives", "Bowls"], "Office": ["Lamps"]},
    brands={"Garden": ["Fernly", "Mossop"], "Kitchen": ["Brasserie", "Copperworth"], "Office": ["Deskmate"]}, price_ranges={"Garden": [5, 90], "Kitchen": [10, 300]},
)


def simulated_summary(spark, sf_dir):
    """Its numbers come from hashes, so SQL cannot follow; tests hold the tables against their rules."""
    return simulate.summary(simulate.simulate(spark, TOYS))


@query("select unnest(['funnel.clicks','funnel.favorite','funnel.add_to_cart','funnel.purchase','chains','clicks_per_request','one_query_per_request','preference','position','band.ctr','band.avg_clicks','band.fav_click','band.atc_click','band.pur_click','band.pur_atc']) name, 0::bigint n_bad, true passed")
def simulated_rules(spark, sf_dir):
    """Simulated events break no rule."""
    made = simulate.simulate(spark, TOYS)
    return checks.business_rules(made["events"], made["items"], made["users"], TOYS.max_clicks_per_request)


QUERIES["simulated_summary"] = simulated_summary
