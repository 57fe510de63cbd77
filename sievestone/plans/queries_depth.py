"""Queries of contamination by text, mergeable reports, versions, graphs, choices, predictors and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.working import shared_folder, written
from ..operators import causes, contamination, coresets, drift, graph, privacy, selection, sketches, tabular, thresholds
from . import versions
from .catalogue import query, t

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SHINGLES = "unnest(case when len(w) = 0 then [] else list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) end)"


@query("contamination_contained", f"""with i as (select item_id as k, {WORDS} as w from benchmark), d as (select doc_id as k, {WORDS} as w from documents),
    a as (select distinct k, {SHINGLES} as s from i), b as (select distinct k, {SHINGLES} as s from d), n as (select k, count(*) as n from a group by 1),
    p as (select a.k as test_key, b.k as train_key, count(*) / min(n) as c from a join b on a.s = b.s join n on n.k = a.k group by 1, 2 having count(*) >= ceil(min(n) * 0.8 - 1e-9))
    select test_key, count(*) as matches, max(c) as containment, case when max(c) >= 1 then 'critical' when max(c) >= 0.95 then 'high' when max(c) >= 0.9 then 'medium' else 'low' end as severity from p group by 1""", "containment")
def contamination_contained(spark, d):
    return contamination.containment(t(spark, d, "benchmark"), t(spark, d, "documents"), "item_id", "text", "doc_id", "text")


@query("contamination_words", f"""with x as (select doc_id as k, lang = 'en' and doc_id is not null and source in ('src1', 'src2', 'src3') as test, unnest({WORDS}) as w from documents), c as (select k, test, w, count(*) as n from x where length(w) > 1 group by 1, 2, 3),
    r as (select w, 1 + ln((1 + (select count(*) from documents)) / (1 + count(*))) as r from c group by 1), v as (select k, test, c.w, n * r / sqrt(sum(n * r * n * r) over (partition by k)) as v from c join r on r.w = c.w),
    p as (select a.k as test_key, b.k, sum(a.v * b.v) as s from v a join v b on a.w = b.w and a.test and not b.test group by 1, 2 having sum(a.v * b.v) >= 0.9 - 1e-9)
    select test_key, count(*) as matches, max(s) as similarity, case when round(max(s), 9) >= 0.98 then 'critical' when round(max(s), 9) >= 0.95 then 'high' when round(max(s), 9) >= 0.9 then 'medium' else 'low' end as severity from p group by 1""", "similarity")
def contamination_words(spark, d):
    docs = t(spark, d, "documents")
    test = F.coalesce((F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3"), F.lit(False))
    return contamination.similarity(docs.where(test), docs.where(~test), "doc_id", "text", "doc_id", "text")


@query("chunk_sketches", """with c as (select o_orderkey // 10000 as chunk, unnest(['o_totalprice', 'o_custkey']) as "column", unnest([o_totalprice, o_custkey::double]) as v from orders)
    select "column", count(*) as rows, count(*) filter (v is null) as missing, avg(v) as mean, stddev_pop(v) as std, min(v) as least, max(v) as greatest, true as distinct_near, true as median_near, count(distinct chunk) as chunks from c group by 1""", "mean std least greatest")
def chunk_sketches(spark, d):
    o = tabular.chunked(t(spark, d, "orders"), "o_orderkey", 10_000)
    columns = ["o_totalprice", "o_custkey"]
    report = written(sketches.chunk_sketches(o, columns))
    merged = sketches.read_sketches(sketches.merge_sketches(report))
    values = o.select(F.inline(F.array(*[F.struct(F.lit(c).alias("own"), F.col(c).cast("double").alias("v")) for c in columns])))
    met = values.join(F.broadcast(merged.select(F.col("column").alias("own"), "median")), "own")  # a row for each column
    exact = met.groupBy("own").agg(F.count_distinct("v").alias("n"), F.avg((F.col("v") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("median")).cast("int")).alias("upto"))
    chunks = report.groupBy(F.col("column").alias("of")).agg(F.count("*").alias("chunks"))
    joined = merged.join(exact, F.col("column") == F.col("own")).join(chunks, F.col("column") == F.col("of"))
    near = (F.col("below") - sketches.RANK_ERROR <= 0.5) & (F.col("upto") + sketches.RANK_ERROR >= 0.5)
    distinct = F.abs(F.col("distinct") - F.col("n")) <= sketches.DISTINCT_ERROR * F.col("n")
    return joined.select("column", "rows", "missing", "mean", "std", "least", "greatest", distinct.alias("distinct_near"), near.alias("median_near"), "chunks")


@query("version_diff", """with a as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderpriority <> '1-URGENT' or o_orderstatus <> 'P'),
    b as (select o_orderkey, o_orderstatus, case when o_orderstatus = 'P' then o_totalprice * 2 else o_totalprice end as o_totalprice from orders where not (o_orderpriority = '5-LOW' and o_orderstatus = 'P'))
    select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' else 'changed' end as change from a full join b on a.o_orderkey = b.o_orderkey
    where a.o_orderkey is null or b.o_orderkey is null or a.o_totalprice <> b.o_totalprice""")
def version_diff(spark, d):
    o = t(spark, d, "orders")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    store = versions.Versions(spark, shared_folder(spark), ["o_orderkey"], buckets=32)
    one = store.commit(o.where("o_orderpriority <> '1-URGENT' or o_orderstatus <> 'P'").select(columns), "without urgent pending ones")
    doubled = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))
    two = store.commit(o.where("not (o_orderpriority = '5-LOW' and o_orderstatus = 'P')").withColumn("o_totalprice", doubled).select(columns), "pending ones doubled")
    return store.diff(one, two)


@query("k_centers")
def k_centers(spark, d):
    e = t(spark, d, "embeddings")
    chosen = coresets.k_centers(e, "vec_id", "embedding", 25)
    return coresets.covered(e, "vec_id", "embedding", written(chosen)).groupBy("centre").agg(F.count("*").alias("rows"), F.max("distance").alias("radius"))


DRAW = "(('0x' || substr(md5('42|' || {k}::varchar), 1, 12))::bigint + 1) / 281474976710656.0"


@query("weighted_sample", f"select o_orderkey, o_totalprice as weight, -ln({DRAW.format(k='o_orderkey')}) / o_totalprice as draw from orders where o_totalprice > 0 order by 3, 1 limit 500", "weight")
def weighted_sample(spark, d):
    return coresets.weighted_sample(t(spark, d, "orders"), "o_orderkey", "o_totalprice", 500)


@query("correction_weighted", f"""with p as (select o_orderpriority as label, count(*) as past from orders where o_orderstatus = 'P' group by 1), s as (select o_orderkey, o_totalprice * (1 + 0.1 * least(coalesce(past, 0), 10)) as weight from orders left join p on label = o_orderpriority)
    select o_orderkey, weight, -ln({DRAW.format(k='o_orderkey')}) / weight as draw from s order by 3, 1 limit 300""", "weight")
def correction_weighted(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_totalprice", "score")
    weighted = selection.corrected_weights(o, o.where("o_orderstatus = 'P'"), "o_orderkey", "o_orderpriority")
    return coresets.weighted_sample(weighted, "o_orderkey", "score", 300)


ISSUES = "select 'outlier' as kind, o_orderkey as key, least(o_totalprice / 600000, 1.0) as confidence from orders where o_totalprice > 350000 union all select 'missing', o_orderkey, 0.5 from orders where o_orderstatus = 'P' union all select 'label_error', o_orderkey, 0.8 from orders where o_orderstatus = 'F' and o_totalprice < 20000"
FACTOR = {m: "case kind " + " ".join(f"when '{k}' then {v[m]}" for k, v in graph.FACTORS.items()) + " else 0 end" for m in graph.METRICS}


def issue_graph(spark, d):
    o = t(spark, d, "orders")
    found = {
        "outlier": o.where("o_totalprice > 350000").select("o_orderkey", F.least(F.col("o_totalprice") / 600000, F.lit(1.0)).alias("confidence")),
        "missing": o.where("o_orderstatus = 'P'"),
        "label_error": o.where("o_orderstatus = 'F' and o_totalprice < 20000").select("o_orderkey", F.lit(0.8).alias("confidence")),
    }
    nodes = graph.issue_nodes(found, "o_orderkey")
    links = graph.edges(nodes, o, "o_orderkey", {"customer": "o_custkey", "priority": "o_orderpriority"})
    nations = t(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("target"), F.lit("belongs").alias("kind"), F.lit(1.0).alias("weight"))
    return nodes, links.unionByName(nations)


@query("issue_impact", f"""with recursive i as ({ISSUES}), n as (select 'issue:' || kind || ':' || key as node, kind, key, confidence from i),
    e as (select node as s, 'row:' || key as t, confidence as w from n union all select 'row:' || o_orderkey, 'customer:' || o_custkey, 1 from orders union all select 'row:' || o_orderkey, 'priority:' || o_orderpriority, 1 from orders union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 1 from customer),
    p(node, depth, accuracy, "precision", recall, f1) as (select node, 0, {', '.join(f'({FACTOR[m]})::double' for m in graph.METRICS)} from n union all select e.t, depth + 1, accuracy * w, "precision" * w, recall * w, f1 * w from p join e on e.s = p.node where depth < 3)
    select node, sum(accuracy) as accuracy, sum("precision") as "precision", sum(recall) as recall, sum(f1) as f1 from p where node not like 'issue:%' group by 1""", "accuracy precision recall f1")
def issue_impact(spark, d):
    nodes, links = issue_graph(spark, d)
    return graph.fix_impact(nodes, links, depth=3)


@query("fix_gains", f"""with i as ({ISSUES}) select count(*) as issues, count(distinct key) as rows, {', '.join(f'least(0.15, sum({FACTOR[m]} * confidence)) as "{m}"' for m in graph.METRICS)}, least(0.95, 0.5 + 0.01 * count(*)) as confidence from i""", "accuracy precision recall f1 confidence")
def fix_gains(spark, d):
    return graph.whole_impact(issue_graph(spark, d)[0])


CUTS = [k / 20 for k in range(1, 20)]
SCORED = "select o_orderkey % 5 as fold, o_totalprice / 500000 as score, (o_orderstatus = 'F' or o_totalprice > 300000)::int as y from orders"
COUNTED = "select {by} threshold, sum((score >= threshold and y = 1)::int) as tp, sum((score >= threshold and y = 0)::int) as fp, sum(y) as p, count(*) as n from s, c group by {group}"
F1 = "coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {p} - {tp}, 0), 0)"


def scored(spark, d):
    o = t(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 5).alias("fold"), (F.col("o_totalprice") / 500000).alias("score"), ((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 300000)).cast("int").alias("y"))


@query("threshold_grid", f"""with s as ({SCORED}), c as (select unnest({CUTS}) as threshold), g as ({COUNTED.format(by='', group='1')})
    select threshold, coalesce(tp / nullif(tp + fp, 0), 0) as "precision", coalesce(tp / nullif(p, 0), 0) as recall, {F1.format(tp='tp', fp='fp', p='p')} as f1, (tp + n - p - fp) / n as accuracy, (coalesce(tp / nullif(p, 0), 0) + coalesce((n - p - fp) / nullif(n - p, 0), 0)) / 2 as balanced from g""", "threshold precision recall f1 accuracy balanced")
def threshold_grid(spark, d):
    return thresholds.threshold_grid(scored(spark, d), "score", "y", CUTS)


@query("threshold_folds", f"""with s as ({SCORED}), c as (select unnest({CUTS}) as threshold), g as ({COUNTED.format(by='fold,', group='1, 2')}), w as (select *, sum(tp) over t - tp as otp, sum(fp) over t - fp as ofp, sum(p) over t - p as op from g window t as (partition by threshold)),
    m as (select fold, threshold, {F1.format(tp='otp', fp='ofp', p='op')} as train_score, {F1.format(tp='tp', fp='fp', p='p')} as test_score from w)
    select fold, threshold, train_score, test_score from (select *, row_number() over (partition by fold order by round(train_score, 12) desc, threshold) as k from m) where k = 1""", "threshold train_score test_score")
def threshold_folds(spark, d):
    return thresholds.cross_validated(scored(spark, d), "score", "y", CUTS, F.col("fold"))


@query("drift_numbers", """with e as (select event_id % 3 <> 0 as r, ts::date as day, unnest(['value', 'user_id']) as feature, unnest([value, user_id::double]) as v from events), l as (select feature, min(v) as low, max(v) as high from e where r group by 1),
    b as (select r, day, e.feature, least(9, floor((v - low) / ((high - low) / 10)))::int as bin from e join l on l.feature = e.feature where v between low and high),
    f as (select d.day as batch, d.feature, k.bin, (select count(*) from b where r and b.feature = d.feature and b.bin = k.bin) as a, (select count(*) from b where not r and b.feature = d.feature and b.bin = k.bin and b.day = d.day) as n from (select distinct day, feature from b where not r) d, (select unnest(range(10)) as bin) k),
    p as (select batch, feature, greatest(a / sum(a) over w, 1e-4) as x, greatest(n / sum(n) over w, 1e-4) as y from f window w as (partition by batch, feature)), s as (select batch, feature, sum((y - x) * ln(y / x)) as psi from p group by 1, 2)
    select *, case when psi < 0.05 then 'none' when psi < 0.1 then 'low' when psi < 0.2 then 'medium' when psi < 0.5 then 'high' else 'critical' end as severity, psi >= 0.1 as alert from s""", "psi")
def drift_numbers(spark, d):
    e = t(spark, d, "events")
    bins = drift.reference_bins(e.where("event_id % 3 <> 0"), ["value", "user_id"])
    return drift.numeric_monitor(bins, e.where("event_id % 3 = 0").withColumn("day", F.to_date("ts")), "day")


@query("pii_spans")
def pii_spans(spark, d):
    return privacy.spans(t(spark, d, "documents"), "doc_id", ["text"])


@query("pruned_slices")
def pruned_slices(spark, d):
    o = t(spark, d, "lineitem").withColumn("ok", (F.col("l_discount") < 0.08) & (F.col("l_returnflag") != "R"))
    return causes.pruned_slices(o, "ok", ["l_quantity", "l_tax"], ["l_returnflag", "l_linestatus"])
