"""Queries of drift, causes, annotators, synthetic tables, history and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.working import written
from ..operators import annotators, causes, drift, history, outliers, selection, synthetic, vectors
from ..streaming import live
from .catalogue import query, t
from .queries_text import NEAR


def halves(spark, d):
    e = t(spark, d, "events")
    return e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0")


A, B = "select * from events where event_id % 3 <> 0", "select * from events where event_id % 3 = 0"
CDF = f"""select x, lead(x) over (order by x) as nx, sum(r) over (order by x) / sum(r) over () as f, sum(s) over (order by x) / sum(s) over () as g from (select value as x, count(*) filter (event_id % 3 <> 0) as r, count(*) filter (event_id % 3 = 0) as s from events where value is not null group by 1)"""


@query("drift_ks", f"select 'value' as feature, max(abs(f - g)) as ks, sum(abs(f - g) * (coalesce(nx, x) - x)) / (max(x) - min(x)) as wasserstein from ({CDF})", "ks wasserstein")
def drift_ks(spark, d):
    return drift.numeric_drift(*halves(spark, d), "value").select("feature", "ks", "wasserstein")


@query("drift_psi", f"""with l as (select min(value) a, max(value) b from ({A})), c as (select least(9, floor((value - a) / ((b - a) / 10)))::int as bin, event_id % 3 <> 0 as r from events, l where value between a and b),
    n as (select i as bin, count(*) filter (r) as p, count(*) filter (not r) as q from (select unnest(range(10)) as i) left join c on bin = i group by 1), t as (select greatest(p / sum(p) over (), 1e-4) as p, greatest(q / sum(q) over (), 1e-4) as q from n)
    select 'value' as feature, sum((q - p) * ln(q / p)) as psi from t""", "psi")
def drift_psi(spark, d):
    return drift.psi(*halves(spark, d), "value")


@query("drift_psi_categorical", "with n as (select event_type, count(*) filter (event_id % 3 <> 0) as p, count(*) filter (event_id % 3 = 0) as q from events group by 1), t as (select greatest(p / sum(p) over (), 1e-4) as p, greatest(q / sum(q) over (), 1e-4) as q from n) select 'event_type' as feature, sum((q - p) * ln(q / p)) as psi from t", "psi")
def drift_psi_categorical(spark, d):
    return drift.categorical_psi(*halves(spark, d), "event_type")


@query("drift_chi2", "with n as (select event_type, count(*) filter (event_id % 3 <> 0) as p, count(*) filter (event_id % 3 = 0) as q from events group by 1), t as (select 1000 * p / sum(p) over () as e, 1000 * q / sum(q) over () as o from n) select 'event_type' as feature, sum((o - e) * (o - e) / e) as chi2, sum((o - e) * (o - e) / e) / 1000 as score from t", "chi2 score")
def drift_chi2(spark, d):
    return drift.categorical_drift(*halves(spark, d), "event_type").select("feature", "chi2", "score")


@query("drift_report")
def drift_report(spark, d):
    return drift.report(*halves(spark, d), ["value"], ["event_type"])


@query("category_domain", "select event_type as value, count(*) filter (event_id % 3 <> 0) as a, count(*) filter (event_id % 3 = 0) as b from events group by 1")
def category_domain(spark, d):
    return drift.category_counts(*halves(spark, d), "event_type")


def flagged(spark, d):
    return t(spark, d, "events").withColumn("issue", (F.col("value") > 60) | (F.col("event_type") == "error"))


ISSUE = "(value > 60 or event_type = 'error')"


@query("cause_factors", f"""with w as (select count(*) as n, count(*) filter {ISSUE.replace('(', '(where ', 1)} as k from events), c as (select 'event_type' as factor, event_type as value, count(*) as rows, count(*) filter (where {ISSUE}) as issues from events group by 2 union all select 'user_id', user_id::varchar, count(*), count(*) filter (where {ISSUE}) from events group by 2),
    x as (select *, issues::double a, rows::double r, n::double nn, k::double kk from c, w where rows >= 30)
    select factor, value, rows, issues, a / r as rate, (a / r) / (kk / nn) as lift, coalesce(nn * pow(greatest(0, abs(a * (nn - r - kk + a) - (r - a) * (kk - a)) - nn / 2), 2) / nullif(r * (nn - r) * kk * (nn - kk), 0), 0) as chi2 from x""", "rate lift chi2")
def cause_factors(spark, d):
    return causes.categorical_factors(flagged(spark, d), ["event_type", "user_id"], "issue")


@query("cause_significant")
def cause_significant(spark, d):
    return causes.categorical_causes(flagged(spark, d), ["event_type", "user_id"], "issue")


@query("cause_numeric", f"select 'value' as factor, corr(value, {ISSUE}::int) as correlation, count(value)::double as n from events", "correlation")
def cause_numeric(spark, d):
    return causes.numeric_factors(flagged(spark, d), ["value"], "issue").drop("p_value")


@query("cause_quartiles", f"with q as (select quantile_cont(value, 0.25) a, quantile_cont(value, 0.5) b, quantile_cont(value, 0.75) c from events) select case when value <= a then 1 when value <= b then 2 when value <= c then 3 else 4 end as quartile, count(*) as rows, avg({ISSUE}::int) as rate from events, q where value is not null group by 1", "rate")
def cause_quartiles(spark, d):
    return causes.quartile_rates(flagged(spark, d), "value", "issue")


@query("cause_daily", f"select ts::date as day, count(*) as rows, count(*) filter (where {ISSUE}) as issues, avg({ISSUE}::int) as rate from events group by 1", "rate")
def cause_daily(spark, d):
    return causes.daily_rates(flagged(spark, d), "ts", "issue")


@query("cause_weekly", f"select weekofyear(ts)::int as week, count(*) as rows, avg({ISSUE}::int) as rate from events group by 1", "rate")
def cause_weekly(spark, d):
    return causes.calendar_rates(flagged(spark, d), "ts", "issue", "week")


@query("cause_weekday", f"select (isodow(ts) - 1)::int as weekday, count(*) as rows, avg({ISSUE}::int) as rate from events group by 1", "rate")
def cause_weekday(spark, d):
    return causes.calendar_rates(flagged(spark, d), "ts", "issue", "weekday")


@query("cause_spikes", f"with x as (select ts::date as day, avg({ISSUE}::int) as rate from events group by 1) select day, rate from x, (select avg(rate) m, stddev_pop(rate) s, count(*) n from x) where n >= 7 and rate > m + 1.5 * s", "rate")
def cause_spikes(spark, d):
    return causes.spikes(flagged(spark, d), "ts", "issue", 1.5)


@query("cause_trend", f"with x as (select avg({ISSUE}::int) as rate, row_number() over (order by ts::date) - 1 as i from events group by ts::date) select regr_slope(rate, i) as slope, regr_r2(rate, i) as r2 from x", "slope r2")
def cause_trend(spark, d):
    return causes.time_trend(flagged(spark, d), "ts", "issue")


def predicted(spark, d):
    o = t(spark, d, "orders")
    return o.withColumn("correct", ~((F.col("o_orderkey") % 17 == 0) | ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0))))


CORRECT = "not (o_orderkey % 17 = 0 or (o_orderstatus = 'F' and o_orderkey % 3 = 0))"


@query("slices", f"""with w as (select count(*) as n, avg(({CORRECT})::int) as base from orders), x as (select unnest(['o_orderstatus=' || o_orderstatus, 'o_orderpriority=' || o_orderpriority, 'o_orderstatus=' || o_orderstatus || ' & ' || 'o_orderpriority=' || o_orderpriority]) as slice, ({CORRECT})::int as ok from orders)
    select slice, count(*) as rows, avg(ok) as accuracy, any_value(base) - avg(ok) as gap from x, w group by 1 having count(*) >= 50 and count(*) >= 0.01 * any_value(n)""", "accuracy gap")
def slices(spark, d):
    return causes.slices(predicted(spark, d), "correct", [], ["o_orderstatus", "o_orderpriority"], 2).select("slice", "rows", "accuracy", "gap")


@query("weak_slices")
def weak_slices(spark, d):
    return causes.weak_slices(predicted(spark, d), "correct", ["o_totalprice"], ["o_orderstatus", "o_orderpriority"], 2)


def rated(spark, d):
    return t(spark, d, "events").select((F.col("event_id") % 2500).alias("sample_id"), (F.col("event_id") % 10000 / 2500).cast("int").alias("annotator_id"), F.when(F.col("event_type").isin("view", "click"), "a").otherwise("b").alias("label"), F.lit("a").alias("ground_truth"), F.col("event_type").alias("category"), "ts")


RATED = "select event_id % 2500 as sample_id, ((event_id % 10000) // 2500)::int as annotator_id, case when event_type in ('view', 'click') then 'a' else 'b' end as label, 'a' as ground_truth, event_type as category, ts from events"


@query("percent_agreement", f"select 100 * avg((k = 1)::int) as percent_agreement from (select count(*) as n, count(distinct label) as k from ({RATED}) group by sample_id) where n > 1", "percent_agreement")
def percent_agreement(spark, d):
    return annotators.percent_agreement(rated(spark, d))


@query("cohen_kappa", f"with p as (select x.label as x, y.label as y from ({RATED}) x join ({RATED}) y using (sample_id) where x.annotator_id = 0 and y.annotator_id = 1), o as (select avg((x = y)::int) as po from p), e as (select sum(a * b) as pe from (select x as l, count(*) / (select count(*) from p) as a from p group by 1) join (select y as l, count(*) / (select count(*) from p) as b from p group by 1) using (l)) select (po - pe) / (1 - pe) as kappa from o, e", "kappa")
def cohen_kappa(spark, d):
    return annotators.cohen_kappa(rated(spark, d), 0, 1)


@query("fleiss_kappa", f"with c as (select sample_id, label, count(*) as c from ({RATED}) group by 1, 2), s as (select sample_id, sum(c) as n, sum(c * (c - 1)) as same from c group by 1 having sum(c) = 4), q as (select label, sum(c) as c from c where sample_id in (select sample_id from s) group by 1), e as (select sum(pow(c / (select sum(c) from q), 2)) as pe from q), m as (select avg(same / 12) as pm from s) select (pm - pe) / (1 - pe) as kappa from m, e", "kappa")
def fleiss_kappa(spark, d):
    return annotators.fleiss_kappa(rated(spark, d), 4)


@query("krippendorff_alpha", f"with c as (select sample_id, label, count(*) as c from ({RATED}) group by 1, 2), s as (select sample_id, sum(c) as n, sum(c * c) as sq from c group by 1 having sum(c) > 1), o as (select sum((n * n - sq) / (n - 1)) as d, sum(n) as t from s), q as (select sum(x * x) as sq from (select sum(c) as x from c where sample_id in (select sample_id from s) group by label)) select 1 - d / ((t * t - sq) / (t - 1)) as alpha from o, q", "alpha")
def krippendorff_alpha(spark, d):
    return annotators.krippendorff_alpha(rated(spark, d))


@query("annotator_agreement", f"select x.annotator_id, avg((x.label = y.label)::int) as agreement from ({RATED}) x join ({RATED}) y on x.sample_id = y.sample_id and x.annotator_id <> y.annotator_id group by 1", "agreement")
def annotator_agreement(spark, d):
    return annotators.pairwise_agreement(rated(spark, d))


@query("annotator_accuracy", f"select annotator_id, avg((label = ground_truth)::int) as accuracy from ({RATED}) group by 1", "accuracy")
def annotator_accuracy(spark, d):
    return annotators.accuracy(rated(spark, d))


@query("problematic_samples", f"select sample_id, sum(c)::bigint as ratings, max(c) / sum(c) as agreement_ratio from (select sample_id, label, count(*) as c from ({RATED}) group by 1, 2) group by 1 having sum(c) > 1 and max(c) / sum(c) < 0.6", "agreement_ratio")
def problematic_samples(spark, d):
    return annotators.problematic_samples(rated(spark, d))


@query("majority_vote", f"with c as (select sample_id, label, count(*) as votes from ({RATED}) group by 1, 2), m as (select sample_id, max(votes) as votes from c group by 1) select sample_id, case when count(*) = 1 then min(label) end as label, votes from c join m using (sample_id, votes) group by sample_id, votes")
def majority_vote(spark, d):
    return annotators.majority_vote(rated(spark, d))


@query("annotation_queue", f"select sample_id, sum(c)::bigint as ratings, max(c) / sum(c) as agreement_ratio from (select sample_id, label, count(*) as c from ({RATED}) group by 1, 2) group by 1 having sum(c) > 1 order by agreement_ratio, sample_id limit 100", "agreement_ratio")
def annotation_queue(spark, d):
    return annotators.review_queue(rated(spark, d))


@query("labeler_metrics", f"""with o as (select annotator_id, count(*) as tasks, avg((label = ground_truth)::int) as accuracy from ({RATED}) group by 1), p as (select x.annotator_id, avg((x.label = y.label)::int) as agreement from ({RATED}) x join ({RATED}) y on x.sample_id = y.sample_id and x.annotator_id <> y.annotator_id group by 1)
    select annotator_id, tasks, accuracy, coalesce(agreement, 0.5) as agreement, case when accuracy >= 0.95 and tasks >= 1000 then 'master' when accuracy >= 0.9 and tasks >= 500 then 'expert' when accuracy >= 0.8 and tasks >= 100 then 'intermediate' else 'novice' end as expertise, cume_dist() over (order by accuracy) as percentile from o left join p using (annotator_id)""", "accuracy agreement percentile")
def labeler_metrics(spark, d):
    return annotators.labeler_metrics(rated(spark, d), "annotator_id", "sample_id")


@query("labeler_consistency", f"select annotator_id, avg(s) as consistency from (select annotator_id, category, max(c) / sum(c) as s from (select annotator_id, category, label, count(*) as c from ({RATED}) group by 1, 2, 3) group by 1, 2) group by 1", "consistency")
def labeler_consistency(spark, d):
    return annotators.category_consistency(rated(spark, d), "annotator_id")


@query("labeler_trend", f"with r as (select annotator_id, row_number() over (partition by annotator_id order by ts) * 2 <= count(*) over (partition by annotator_id) as f, (label = ground_truth)::int as ok from ({RATED})), g as (select annotator_id, avg(ok) filter (f) as early, avg(ok) filter (not f) as late from r group by 1) select *, case when late - early > 0.05 then 'improving' when late - early < -0.05 then 'declining' else 'stable' end as trend from g", "early late")
def labeler_trend(spark, d):
    return annotators.half_trend(rated(spark, d), "annotator_id")


@query("labeler_routing", f"""with a as ({RATED}), m as (select annotator_id, coalesce(avg((label = ground_truth)::int), 0.5) as accuracy from a group by 1), c as (select annotator_id, avg(s) as consistency from (select annotator_id, category, max(c) / sum(c) as s from (select annotator_id, category, label, count(*) as c from a group by 1, 2, 3) group by 1, 2) group by 1),
    k as (select annotator_id, category, avg((label = ground_truth)::int) as own from a group by 1, 2 having count(*) >= 5), x as (select q.category, m.annotator_id, 0.4 * accuracy + 0.2 * consistency + 0.1 + coalesce(0.3 * own, 0.15) as score from (select distinct category from a) q cross join m join c on c.annotator_id = m.annotator_id left join k on k.annotator_id = m.annotator_id and k.category = q.category),
    r as (select *, row_number() over (partition by category order by score desc, annotator_id)::int as rank from x) select sample_id, r.annotator_id, score, rank from a join r using (category) where rank <= 2""", "score")
def labeler_routing(spark, d):
    a = rated(spark, d)
    m = annotators.labeler_metrics(a, "annotator_id", "sample_id").join(annotators.category_consistency(a, "annotator_id"), "annotator_id")
    return annotators.route(a.select("sample_id", "category"), m, annotators.category_skill(a, "annotator_id"), "sample_id", "annotator_id")


@query("synthetic_modes", "select f as feature, s1 / s0 as std_ratio, u1 / u0 as unique_ratio, s1 / s0 < 0.1 or u1 / u0 < 0.5 as collapsed from (select 'o_totalprice' as f, stddev_samp(o_totalprice) filter (o_orderstatus <> 'P') as s0, stddev_samp(o_totalprice) filter (o_orderstatus = 'P') as s1, count(distinct o_totalprice) filter (o_orderstatus <> 'P') as u0, count(distinct o_totalprice) filter (o_orderstatus = 'P') as u1 from orders)", "std_ratio unique_ratio")
def synthetic_modes(spark, d):
    o = t(spark, d, "orders")
    return synthetic.mode_collapse(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'P'"), ["o_totalprice"])


@query("synthetic_gaps", f"select 'value' as feature, max(abs(f - g)) as gap, 100 - 100 * max(abs(f - g)) as fidelity from ({CDF}) union all select 'event_type', sum(abs(p - q)) / 2, 100 - 50 * sum(abs(p - q)) from (select p / sum(p) over () as p, q / sum(q) over () as q from (select count(*) filter (event_id % 3 <> 0) as p, count(*) filter (event_id % 3 = 0) as q from events group by event_type))", "gap fidelity")
def synthetic_gaps(spark, d):
    return synthetic.distribution_gaps(*halves(spark, d), ["value"], ["event_type"])


@query("synthetic_correlations", "select 'l_quantity' as a, 'l_extendedprice' as b, corr(l_quantity, l_extendedprice) filter (l_orderkey % 2 = 0) as real, corr(l_quantity, l_extendedprice) filter (l_orderkey % 2 = 1) as synthetic, abs(corr(l_quantity, l_extendedprice) filter (l_orderkey % 2 = 0) - corr(l_quantity, l_extendedprice) filter (l_orderkey % 2 = 1)) as gap from lineitem", "real synthetic gap")
def synthetic_correlations(spark, d):
    x = t(spark, d, "lineitem")
    return synthetic.correlation_gaps(x.where("l_orderkey % 2 = 0"), x.where("l_orderkey % 2 = 1"), ["l_quantity", "l_extendedprice"])


@query("synthetic_memorisation", """with b as (select avg(c_acctbal) m, stddev_samp(c_acctbal) s, avg(c_nationkey) n, stddev_samp(c_nationkey) r from customer where c_custkey % 2 = 0), v as (select c_custkey as k, (c_acctbal - m) / s as x, (c_nationkey - n) / r as y from customer, b),
    d as (select a.k, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d from v a, v b where a.k % 3 = 0 and b.k % 2 = 0 group by 1) select count(*) as rows, count(*) filter (d < 0.1) as copied, avg((d < 0.1)::int) as rate, greatest(0, 100 - 200 * avg((d < 0.1)::int)) as privacy from d""", "rate privacy")
def synthetic_memorisation(spark, d):
    c = t(spark, d, "customer")
    return synthetic.memorisation(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), "c_custkey", ["c_acctbal", "c_nationkey"])


@query("synthetic_diversity", """with v as (select c_custkey as k, (c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over () as x, (c_nationkey - avg(c_nationkey) over ()) / stddev_samp(c_nationkey) over () as y from customer), d as (select a.k, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d from v a join v b on a.k <> b.k group by 1)
    select least(100, 50 * avg(d)) as diversity from d""", "diversity")
def synthetic_diversity(spark, d):
    return synthetic.diversity(t(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])


@query("gaussian_copula")
def gaussian_copula(spark, d):
    return synthetic.gaussian_copula(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 1000)


@query("synthetic_certificate", """with m as (select 100 * avg((text is not null)::int) as fidelity, 100 * count(distinct text) / count(*) as privacy, 100 * avg((n_chars >= 50)::int) as utility, 10.0 * count(distinct lang) as diversity, 100 * avg((lang = 'en')::int) as coherence from documents)
    select 0.25 * fidelity + 0.3 * privacy + 0.25 * utility + 0.1 * diversity + 0.1 * coherence as overall, f as failed, case when f = '' then 'certified' when not contains(f, ',') then 'conditional' else 'rejected' end as status
    from (select *, concat_ws(',', case when coherence < 70 then 'coherence' end, case when diversity < 60 then 'diversity' end, case when fidelity < 70 then 'fidelity' end, case when privacy < 80 then 'privacy' end, case when utility < 70 then 'utility' end) as f from m)""", "overall")
def synthetic_certificate(spark, d):
    share = lambda c: 100 * F.avg(c.cast("int"))
    m = t(spark, d, "documents").agg(share(F.col("text").isNotNull()).alias("fidelity"), (100 * F.count_distinct("text") / F.count("*")).alias("privacy"), share(F.col("n_chars") >= 50).alias("utility"), (10.0 * F.count_distinct("lang")).alias("diversity"), share(F.col("lang") == "en").alias("coherence"))
    return synthetic.certificate(m)


@query("augmentation_plan", "with c as (select toxic as label, count(*) as count from labels group by 1), m as (select max(count) as most from c), p as (select label, count, greatest(least((most / 2)::double::bigint, count * 5), 10) as target from c, m where most / count > 2) select label, count, floor(target)::bigint as target, target / count as multiplier, case when target / count <= 2 then 'oversample' when target / count <= 3 then 'noise' else 'smote' end as operation from (select label, count, greatest(least(floor((select most from m) / 2)::bigint, count * 5), 10) as target from p)", "multiplier")
def augmentation_plan(spark, d):
    return synthetic.augmentation_plan(t(spark, d, "labels"), "toxic")


@query("oversample", "select toxic, case when toxic = 0 then c else greatest(c, least(floor((select max(c) from (select count(*) as c from labels group by toxic)) / 2), c * 5))::bigint end as n from (select toxic, count(*) as c from labels group by 1)")
def oversample(spark, d):
    x = t(spark, d, "labels")
    return synthetic.oversample(x, "toxic", "doc_id", synthetic.augmentation_plan(x, "toxic")).groupBy("toxic").agg(F.count("*").alias("n"))


@query("smote")
def smote(spark, d):
    return synthetic.smote(t(spark, d, "embeddings").where("label = 1"), "vec_id", "embedding")


@query("local_outlier_factor", f"""with n as (select query, key, sqrt(greatest(0, 2 - 2 * similarity)) as distance from ({NEAR}) where rank <= 10), k as (select query as key, max(distance) as kd from n group by 1), r as (select query, 1 / (avg(greatest(distance, kd)) + 1e-10) as density from n join k using (key) group by 1)
    select n.query, avg(b.density) / any_value(a.density) as lof from n join r a on a.query = n.query join r b on b.query = n.key group by 1""", "lof")
def local_outlier_factor(spark, d):
    e = t(spark, d, "embeddings")
    near = vectors.top_k(e, e, "vec_id", "embedding", 10).select("query", "key", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("distance"))
    return outliers.local_outlier_factor(written(near))  # read four times


def daily(spark, d):
    return t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("quality"), F.count("*").alias("rows"))


DAILY = "select ts::date as day, avg(value) as quality, count(*) as rows from events group by 1"


@query("trend", f"with x as (select quality, row_number() over (order by day) - 1 as i from (select * from ({DAILY}) order by day desc limit 10)) select count(*) as n, regr_slope(quality, i) * count(*) / (max(quality) - min(quality)) as slope, regr_r2(quality, i) as r2, case when regr_slope(quality, i) * count(*) / (max(quality) - min(quality)) > 0.1 then 'up' when regr_slope(quality, i) * count(*) / (max(quality) - min(quality)) < -0.1 then 'down' else 'stable' end as direction from x", "slope r2")
def trend(spark, d):
    return history.trend(daily(spark, d), "day", "quality", 10)


@query("snapshot_changes", f"with x as (select day, quality as value, lag(quality) over (order by day) as b from ({DAILY})) select day, 'quality' as metric, value, value - b as delta, 100 * (value - b) / abs(b) as percent, case when 100 * (value - b) / abs(b) > 1 then 'improved' when 100 * (value - b) / abs(b) < -1 then 'degraded' else 'unchanged' end as change from x where b is not null", "value delta percent")
def snapshot_changes(spark, d):
    return history.changes(daily(spark, d), "day", ["quality"])


@query("rolling_rates", "select event_type, event_id, avg((value > 60)::int::double) over (partition by event_type order by event_id rows between 99 preceding and current row) as high_rate from events", "high_rate")
def rolling_rates(spark, d):
    return history.rolling(t(spark, d, "events").withColumn("high", F.col("value") > 60), ["event_type"], "event_id", ["high"], 100).select("event_type", "event_id", "high_rate")


@query("constant_step", "select count(distinct s) = 1 as sequential, min(s) as step from (select c_custkey - lag(c_custkey) over (order by c_custkey) as s from customer) where s is not null")
def constant_step(spark, d):
    return history.steps(t(spark, d, "customer"), "c_custkey", "c_custkey")


@query("leaderboard", "with x as (select s_name as name, s_acctbal as score from supplier) select name, score, row_number() over (order by score desc, name)::int as rank, 100 * (select count(*) from x y where y.score < x.score) / (select count(*) from x) as percentile from x order by score desc, name limit 10", "percentile")
def leaderboard(spark, d):
    return history.leaderboard(t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("score")), "name", "score")


@query("industry_percentiles", "select c_mktsegment, count(*) as n, avg(c_acctbal) as mean, stddev_pop(c_acctbal) as std, quantile_cont(c_acctbal, 0.1) as p10, quantile_cont(c_acctbal, 0.25) as p25, quantile_cont(c_acctbal, 0.5) as p50, quantile_cont(c_acctbal, 0.75) as p75, quantile_cont(c_acctbal, 0.9) as p90, quantile_cont(c_acctbal, 0.95) as p95, quantile_cont(c_acctbal, 0.99) as p99 from customer group by 1 having count(*) >= 3", "mean std p10 p25 p50 p75 p90 p95 p99")
def industry_percentiles(spark, d):
    return history.percentiles(t(spark, d, "customer"), "c_mktsegment", "c_acctbal")


@query("degradation", f"with x as (select quality as s, row_number() over (order by day) as i, count(*) over () as n from ({DAILY})), y as (select avg(s) filter (i <= 10) as baseline, avg(s) filter (i > n - 10) as recent from x) select baseline, recent, (baseline - recent) / baseline as drop, (baseline - recent) / baseline > 0.05 as degraded from y", "baseline recent drop")
def degradation(spark, d):
    return history.degradation(daily(spark, d), "day", "quality")


@query("last_decisions", "select user_id, arg_max(event_type, event_id) as decision, count(*) as events from events group by 1")
def last_decisions(spark, d):
    return history.last_decisions(t(spark, d, "events"), "user_id", "event_type", "event_id")


@query("performance_drop", f"with x as (select day, quality as value, avg(quality) over w as baseline, stddev_pop(quality) over w as s from ({DAILY}) window w as (order by day rows between 5 preceding and 1 preceding)) select day, value, baseline, (baseline - value) / baseline as drop, coalesce((value - baseline) / nullif(s, 0), 0) as z from x where baseline is not null", "value baseline drop z")
def performance_drop(spark, d):
    return causes.performance_drop(daily(spark, d), "day", "quality").select("day", "value", "baseline", "drop", "z")


@query("detector_comparison", "select event_type, count(*) as runs, avg(value) as value_mean, stddev_samp(value) as value_std from events group by 1", "value_mean value_std")
def detector_comparison(spark, d):
    return history.detector_comparison(t(spark, d, "events"), "event_type", ["value"])


@query("feedback_correlation", "select 'high' as issue, corr((value > 60)::int, (event_type = 'error')::int) as correlation, avg((event_type = 'error')::int) filter (value > 60) - avg((event_type = 'error')::int) filter (value <= 60) as effect from events", "correlation effect")
def feedback_correlation(spark, d):
    e = t(spark, d, "events").withColumns({"high": F.col("value") > 60, "error": (F.col("event_type") == "error").cast("int")})
    return history.feedback_correlation(e, ["high"], "error")


SITES = """with s as (select *, case when o_orderkey % 7 = 0 then null else o_totalprice end as price, o_custkey % 4 as site from orders), a as (select site, count(*) as rows, avg((price is null)::int) as missing_rate, 1 - count(distinct (price, o_orderpriority)) / count(*) as duplicate_rate from s group by 1),
    c as (select site, max(n) / min(n) as class_ratio from (select site, o_orderstatus, count(*) as n from s group by 1, 2) group by 1), x as (select site, rows, missing_rate, 1 - (select count(*) from (select distinct price, o_orderpriority from s where s.site = a.site)) / rows as duplicate_rate, class_ratio from a join c using (site))
    select *, greatest(0, 100 - 30 * missing_rate - 20 * duplicate_rate - case when class_ratio > 10 then 15 when class_ratio > 5 then 10 when class_ratio > 2 then 5 else 0 end) as score from x"""


def sites(spark, d):
    o = t(spark, d, "orders").withColumns({"price": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")), "site": F.col("o_custkey") % 4})
    return history.site_reports(o.select("site", "o_orderstatus", F.col("price"), "o_orderpriority"), "site", "o_orderstatus", ["price", "o_orderpriority"])


@query("site_reports", SITES.replace("avg((price is null)::int)", "avg((price is null)::int) / 2"), "missing_rate duplicate_rate class_ratio score")
def site_reports(spark, d):
    return sites(spark, d)


@query("site_pool", f"select sum(rows)::bigint as rows, sum(missing_rate * rows) / sum(rows) as missing_rate, sum(duplicate_rate * rows) / sum(rows) as duplicate_rate, sum(score * rows) / sum(rows) as score from ({SITES.replace('avg((price is null)::int)', 'avg((price is null)::int) / 2')})", "missing_rate duplicate_rate score")
def site_pool(spark, d):
    return history.pooled(sites(spark, d))


@query("cost_impact", "select 'duplicate' as kind, count(*) - count(distinct text) as n, 0.0 as cost, 0.01 as gain from documents union all select 'outlier', count(*), 0.05 * count(*), 0.005 from orders where o_totalprice > 400000", "cost gain")
def cost_impact(spark, d):
    a = t(spark, d, "documents").agg((F.count("*") - F.count_distinct("text")).alias("n")).select(F.lit("duplicate").alias("kind"), "n")
    b = t(spark, d, "orders").where("o_totalprice > 400000").agg(F.count("*").alias("n")).select(F.lit("outlier").alias("kind"), "n")
    return history.cost_impact(a.unionByName(b))


@query("compliance", "with m as (select 100 * avg(quality) as label, 100 * avg(1 - toxic) as bias, 100 * (select avg((value <= 60)::int) from events) as outlier from labels), x as (select unnest(['data governance', 'bias examination', 'accuracy']) as requirement, unnest(['label', 'bias', 'outlier']) as component, unnest([label, bias, outlier]) as score from m) select *, case when score >= 80 then 'compliant' when score >= 50 then 'partial' else 'non_compliant' end as status from x", "score")
def compliance(spark, d):
    m = t(spark, d, "labels").agg((100 * F.avg("quality")).alias("label"), (100 * F.avg(1 - F.col("toxic"))).alias("bias"))
    m = m.crossJoin(t(spark, d, "events").agg((100 * F.avg((F.col("value") <= 60).cast("int"))).alias("outlier")))
    return history.compliance(m, [("data governance", "label"), ("bias examination", "bias"), ("accuracy", "outlier")])


@query("priority_ranking", "select user_id, sum(case event_type when 'error' then 3.0 when 'purchase' then 1.0 end) as priority from events where event_type in ('error', 'purchase') group by 1 order by priority desc, user_id limit 20", "priority")
def priority_ranking(spark, d):
    return selection.priorities(t(spark, d, "events"), "user_id", "event_type", {"error": 3.0, "purchase": 1.0})


@query("predicted_impact", "select 'duplicate' as kind, count(*) as n, least(0.15, sum(0.002 * 0.9)) as gain from labels where toxic = 1 union all select 'label_error', count(*), least(0.15, sum(0.015 * 0.9)) from labels where toxic = 0", "gain")
def predicted_impact(spark, d):
    x = t(spark, d, "labels").select(F.when(F.col("toxic") == 1, "duplicate").otherwise("label_error").alias("kind"), F.lit(0.9).alias("confidence"))
    return selection.predicted_impact(x, "kind", "confidence")


@query("breadth_first", "with recursive b(node, depth) as (select 0::bigint, 0 union select o.l_suppkey, depth + 1 from b join (select distinct l_partkey, l_suppkey from lineitem) o on o.l_partkey = b.node where depth < 3) select node, min(depth)::int as depth from b group by 1")
def breadth_first(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    return selection.breadth_first(e, spark.createDataFrame([(0,)], "node long"), 3)


@query("event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, sum(value) as total from events group by 1, 2", "total")
def event_windows(spark, d):
    return live.tumbling(t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sessions", "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events), y as (select *, sum(new) over (partition by user_id order by ts) as s from x) select user_id, min(ts) as start, max(ts) + interval '6 hours' as \"end\", count(*) as n from y group by user_id, s")
def event_sessions(spark, d):
    s = live.sessions(t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "user_id")
    return s.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("batch_outliers", "with q as (select quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b from events) select event_id, value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) as is_outlier, case when value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) then 70.0 else 100.0 end as quality from events, q", "quality")
def batch_outliers(spark, d):
    return live.check_batch(t(spark, d, "events"), ["value"]).select("event_id", "is_outlier", "quality")


@query("stream_alerts", "with m as (select avg((value > 20)::int) as o, 1 - count(distinct (event_type, user_id)) / count(*) as r, 100 * avg((event_type <> 'view')::int) as q from events) select 'warning' as severity, 'outliers' as issue, o as value from m where o > 0.1 union all select 'warning', 'duplicates', r from m where r > 0.05 union all select 'critical', 'quality', q from m where q < 70", "value")
def stream_alerts(spark, d):
    share = lambda c: F.avg(c.cast("int"))
    m = t(spark, d, "events").agg(share(F.col("value") > 20).alias("outlier_rate"), (1 - F.count_distinct("event_type", "user_id") / F.count("*")).alias("duplicate_rate"), (100 * share(F.col("event_type") != "view")).alias("quality"))
    return live.alerts(m)
