"""Queries of input checks, chunk reports, contamination by similarity, drift of batches, gaps and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, drift, labels, repairs, synthetic, tabular, vectors
from .catalogue import query, t
from .queries_core import GUESSED, NULLED, guessed, nulled
from .queries_text import COS


@query("validation", "select unnest(['rows', 'features', 'labels', 'classes']) as \"check\", unnest([count(*), 2, count(quality), count(distinct quality)]) as value, unnest([1, 1, 1, 2])::bigint as least from labels")
def validation(spark, d):
    return checks.validate(t(spark, d, "labels"), ["doc_id", "toxic"], "quality").drop("passed")


@query("chunk_labels", "select o_orderkey // 10000 as chunk, o_orderstatus as label, count(*) as count, count(*) / sum(count(*)) over (partition by o_orderkey // 10000) as ratio from orders group by 1, 2", "ratio")
def chunk_labels(spark, d):
    return checks.chunk_labels(tabular.chunked(t(spark, d, "orders"), "o_orderkey", 10_000), "o_orderstatus")


@query("chunks_merged", """with c as (select o_orderkey // 10000 as chunk, o_totalprice from orders), q as (select chunk, quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.75) b from c group by 1),
    r as (select chunk, count(*) as rows, count(*) filter (o_totalprice < a - 1.5 * (b - a) or o_totalprice > b + 1.5 * (b - a)) as outliers, count(*) - count(distinct o_totalprice) as duplicates from c join q using (chunk) group by 1),
    s as (select *, greatest(0, 100 - 100 * (outliers + duplicates) / rows) as score from r)
    select count(*) as chunks, sum(rows)::bigint as rows, sum(outliers)::bigint as outliers, sum(duplicates)::bigint as duplicates, sum(score * rows) / sum(rows) as weighted_score, avg(score) as mean_score from s""", "weighted_score mean_score")
def chunks_merged(spark, d):
    reports = tabular.chunk_report(tabular.chunked(t(spark, d, "orders"), "o_orderkey", 10_000), ["o_totalprice"])
    return checks.merged(reports, ["outliers", "duplicates"])


@query("label_decode", "select c_custkey, c_mktsegment from customer")
def label_decode(spark, d):
    c = t(spark, d, "customer")
    coded = tabular.encode(c, "c_mktsegment").select("c_custkey", "code")
    return tabular.decode(coded, tabular.label_codes(c, "c_mktsegment"), "code", "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("contamination_semantic", f"select test_key, count(*) as matches, max(s) as similarity, case when max(s) >= 0.98 then 'critical' when max(s) >= 0.95 then 'high' when max(s) >= 0.9 then 'medium' else 'low' end as severity from (select a.vec_id as test_key, {COS} as s from embeddings a, embeddings b where a.label = 1 and b.label <> 1) where s >= 0.4 group by 1", "similarity")
def contamination_semantic(spark, d):
    e = t(spark, d, "embeddings")
    return vectors.cross_matches(e.where("label = 1"), e.where("label <> 1"), "vec_id", "embedding", 0.4)


@query("contamination_near", """with m as (select avg(c_acctbal) a, stddev_samp(c_acctbal) s, avg(c_nationkey) b, stddev_samp(c_nationkey) r from customer), c as (select [(c_acctbal - a) / s, (c_nationkey - b) / r] as v from customer, m), x as (select s_suppkey as test_key, [(s_acctbal - a) / s, (s_nationkey - b) / r] as v from supplier, m),
    y as (select test_key, list_cosine_similarity(x.v, c.v) as s from x, c) select test_key, count(*) as matches, round(max(s), 4) as similarity, 'critical' as severity from y where s >= 0.99 group by 1""", "similarity")
def contamination_near(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y"))
    both = [synthetic.standardised(df, "k", ["x", "y"], c) for df in (s, c)]
    return vectors.cross_matches(*both, "key", "v", 0.99).withColumn("similarity", F.round("similarity", 4))


@query("drift_batches", """with r as (select event_type, count(*) as a from events where event_id % 3 <> 0 group by 1), q as (select ts::date as batch, event_type, count(*) as b from events where event_id % 3 = 0 group by 1, 2), k as (select event_type from r union select event_type from q),
    f as (select x.batch, k.event_type, coalesce(a, 0) as a, coalesce(b, 0) as b from (select distinct batch from q) x cross join k left join r on r.event_type = k.event_type left join q on q.batch = x.batch and q.event_type = k.event_type),
    p as (select batch, greatest(a / sum(a) over (partition by batch), 1e-4) as x, greatest(b / sum(b) over (partition by batch), 1e-4) as y from f), s as (select batch, 'event_type' as feature, sum((y - x) * ln(y / x)) as psi from p group by 1)
    select *, case when psi < 0.05 then 'none' when psi < 0.1 then 'low' when psi < 0.2 then 'medium' when psi < 0.5 then 'high' else 'critical' end as severity, psi >= 0.1 as alert from s""", "psi")
def drift_batches(spark, d):
    e = t(spark, d, "events")
    return drift.monitor(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0").withColumn("day", F.to_date("ts")), "day", ["event_type"])


@query("language_label_errors", f"""with g as (select key, o_orderpriority as lang, label, probs from ({GUESSED}) join orders on key = o_orderkey), m as (select lang, label as c, avg(probs[label + 1]) as t from g group by 1, 2),
    x as (select key, g.lang, label as given, i as predicted, row_number() over (partition by key order by probs[i + 1] desc, i) as rn, probs[label + 1] as self_confidence from g, (select unnest([0, 1, 2]) as i) join m on m.c = i where m.lang = g.lang and probs[i + 1] >= t)
    select key, lang, given, predicted, self_confidence from x where rn = 1 and predicted <> given""", "self_confidence")
def language_label_errors(spark, d):
    g = guessed(spark, d).join(t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority"), "key")
    return labels.errors_by_language(g, "key", "label", "probs", "o_orderpriority")


@query("class_gaps", "with c as (select toxic as label, count(*) as rows from labels group by 1), m as (select max(rows) as m from c) select 'imbalance' as gap, label, rows, least(floor(m / 2), rows * 5)::bigint as target, least(m / rows / 10, 1) as severity from c, m where m / rows > 2", "severity")
def class_gaps(spark, d):
    return checks.class_gaps(t(spark, d, "labels"), "toxic")


@query("plausible_rows", "with s as (select o_orderstatus as c, avg(o_totalprice) m, stddev_pop(o_totalprice) s from orders group by 1) select o_orderkey from orders join s on c = o_orderstatus where abs(o_totalprice * 1.5 - m) <= 1.5 * s")
def plausible_rows(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return checks.plausible(o.withColumn("o_totalprice", F.col("o_totalprice") * 1.5), o, "o_orderstatus", ["o_totalprice"], 1.5).select("o_orderkey")


@query("curated", f"with n as ({NULLED}), a as (select avg(price) as m from n), p as (select priority as p from n where priority is not null group by 1 order by count(*) desc, 1 limit 1) select o_orderkey, coalesce(price, m) as price, coalesce(priority, p) as priority from n, a, p", "price")
def curated(spark, d):
    n = nulled(spark, d)
    plan = repairs.curation_plan(n, "o_orderkey", ["price"]).where("action = 'impute'")
    return repairs.carry_out(n, plan, "o_orderkey").select("o_orderkey", "price", "priority")


@query("sampled_rows")
def sampled_rows(spark, d):
    return checks.sample_rows(t(spark, d, "orders"), "o_orderkey", 1000).select("o_orderkey")
