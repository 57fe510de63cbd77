"""Queries of texts, personal data and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import cosine
from ..operators import duplicates, privacy, texts, vectors
from .catalogue import query, t

PAIRS = "select a.conv_id, a.turn, a.text as instruction, b.text as response from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'"
EMAIL = privacy.PII["email"][0][0]


def pairs(spark, d):
    return texts.conversation_pairs(t(spark, d, "conversations"))


@query("conversation_pairs", PAIRS)
def conversation_pairs(spark, d):
    return pairs(spark, d)


@query("text_length_issues", "select * from (select doc_id, case when length(text) < 10 then 'too_short' when length(text) > 10000 then 'too_long' end as issue, case when length(text) < 5 then 'high' else 'medium' end as severity from documents) where issue is not null")
def text_length_issues(spark, d):
    return texts.length_issues(t(spark, d, "documents"), ["doc_id"], "text")


def _coherence(i: str, r: str) -> str:
    refusal = " or ".join(f"""starts_with({r}, '{p.replace("'", "''")}')""" for p in texts.REFUSAL_PREFIXES)
    return f"case when length({r}) > 0 and contains({i}, {r}) then 'repetition' when {refusal} then 'refusal' when length({r}) < 3 then 'empty' end"


# answers of one word, so that there is something to find
TERSE = f"select conv_id, turn, instruction, split_part(instruction, ' ', 1) as response from ({PAIRS})"


def terse(spark, d):
    return pairs(spark, d).withColumn("response", F.split_part(F.col("instruction"), F.lit(" "), F.lit(1)))


# all answers as they are and, as those may be flawless, those of one word too
BOTH = f"select 'given' as answer, conv_id, turn, instruction, response from ({PAIRS}) union all select 'first word', conv_id, turn, instruction, response from ({TERSE})"


@query("coherence_issues", f"select * from (select answer, conv_id, turn, {_coherence('lower(trim(instruction))', 'lower(trim(response))')} as issue from ({BOTH})) where issue is not null")
def coherence_issues(spark, d):
    both = [f(spark, d).withColumn("answer", F.lit(name)) for f, name in ((pairs, "given"), (terse, "first word"))]
    return texts.coherence_issues(both[0].unionByName(both[1]), ["answer", "conv_id", "turn"])


@query("format_issues", "with x as (select doc_id, replace(regexp_replace(text, '\\.$', '...'), '. The', '``` The') as text from documents) select doc_id, 'truncated' as issue, 0.7::double as confidence from x where rtrim(text) like '%...' or rtrim(text) like '%…' union all select doc_id, 'format_error', 0.8 from x where ((length(text) - length(replace(text, '```', ''))) // 3) % 2 = 1")
def format_issues(spark, d):
    marked = F.replace(F.regexp_replace("text", r"\.$", "..."), F.lit(". The"), F.lit("``` The"))
    return texts.format_issues(t(spark, d, "documents").withColumn("text", marked), ["doc_id"], "text")


@query("instruction_report", f"""with p as ({TERSE}), k as (select case when length(response) < 10 then 'too_short' when length(response) > 10000 then 'too_long' end as issue from p union all select {_coherence('lower(trim(instruction))', 'lower(trim(response))')} from p
    union all select 'truncated' from p where rtrim(response) like '%...' or rtrim(response) like '%…' union all select 'format_error' from p where ((length(response) - length(replace(response, '```', ''))) // 3) % 2 = 1)
    select issue, count(*) as n from k where issue is not null group by 1 union all select 'duplicate', count(*) - count(distinct instruction) from p having count(*) > count(distinct instruction)""")
def instruction_report(spark, d):
    return texts.instruction_report(terse(spark, d), ["conv_id", "turn"], ["conv_id", "turn"])


@query("toxic_documents", "select doc_id from documents where regexp_matches(text, '\\b(hate|kill|murder|attack|destroy)\\b.*\\b(people|person|group|them)\\b', 'i') or regexp_matches(text, '\\b(stupid|idiot|moron|dumb)\\b', 'i') or regexp_matches(text, '\\b(racist|sexist|bigot)\\b', 'i')")
def toxic_documents(spark, d):
    return t(spark, d, "documents").where(texts.any_match(F.col("text"), texts.TOXIC)).select("doc_id")


def _any(c: str, patterns: list[str]) -> str:
    quoted = [p.replace("'", "''") for p in patterns]
    return "(" + " or ".join(f"regexp_matches({c}, '{p}')" for p in quoted) + ")"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> '')"


FILL = " + ".join(f"(length(lower(r)) - length(replace(lower(r), '{p}', ''))) // {len(p)}" for p in texts.FILLERS)
UNCERTAIN = " or ".join("contains(lower(r), '" + p.replace("'", "''") + "')" for p in texts.UNCERTAIN)
RESPONSES = f"""with p as (select conv_id, turn, coalesce(instruction, '') as i, coalesce(response, '') as r from ({PAIRS})), w as (select *, {_words('r')} as rw, list_filter(list_distinct({_words('i')}), lambda w: not list_contains({texts.STOP_WORDS}, w)) as asked from p),
    s as (select conv_id, turn, (case when length(r) < 20 then 0.3 when length(r) < 50 then 0.6 else 1.0 end) * (case when coalesce(({FILL}) / nullif(len(rw), 0), 0) > 0.5 then 0.7 else 1.0 end) * (case when len(asked) = 0 or len(list_intersect(asked, rw)) / greatest(len(asked), 1) > 0.1 then 1.0 else 0.5 end) * (case when {_any('r', texts.REFUSAL)} then 0.8 else 1.0 end) as helpfulness,
      (case when {_any('r', texts.TOXIC)} then 0.3 else 1.0 end) * (case when {_any('r', texts.LEAKS)} then 0.5 else 1.0 end) * (case when {_any('lower(r)', texts.HARMFUL)} then 0.2 else 1.0 end) as harmlessness, case when {_any('r', [texts.OVERCONFIDENT])} and not ({UNCERTAIN}) then 0.8 else 1.0 end as honesty, {_any('i', texts.INJECTION)} as injection, {_any('i', texts.JAILBREAK)} as jailbreak from w)
    select *, 0.4 * helpfulness + 0.4 * harmlessness + 0.2 * honesty as overall from s"""


@query("response_scores", RESPONSES, "helpfulness harmlessness honesty overall")
def response_scores(spark, d):
    return texts.evaluate_responses(pairs(spark, d), ["conv_id", "turn"])


@query("honesty", f"""select conv_id, turn, case when regexp_matches(response, 'definitely|certainly|always|never|100%|guaranteed|proven fact', 'i') and not ({' or '.join("contains(lower(response), '" + p.replace("'", "''") + "')" for p in texts.UNCERTAIN)}) then 0.8 else 1.0 end as honesty from ({PAIRS})""", "honesty")
def honesty(spark, d):
    return pairs(spark, d).select("conv_id", "turn", texts.honesty(F.col("response")).alias("honesty"))


@query("toxicity_score", "select doc_id, least(1, 10 * (len(regexp_extract_all(text, '(?i)\\b(shit|damn|hell|crap)\\b')) + len(regexp_extract_all(text, '(?i)\\b(kill|murder|attack|hurt) (you|them|him|her)\\b')) + len(regexp_extract_all(text, '(?i)(going to|gonna) (hurt|kill|attack)')) + len(regexp_extract_all(text, '(?i)(you(''re| are)) (stupid|dumb|idiot)')) + len(regexp_extract_all(text, '(?i)(shut up|go away|leave me alone)'))) / greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))) as score from documents", "score")
def toxicity_score(spark, d):
    return t(spark, d, "documents").select("doc_id", texts.toxicity(F.col("text")).alias("score"))


@query("clarity", """select item_id, (case when length(text) < 10 then 0.5 when length(text) > 2000 then 0.8 else 1.0 end) * (case when regexp_matches(rtrim(text), '[.?!]$') then 1.0 else 0.9 end)
    * (case when regexp_matches(trim(lower(text)), '^(what|how|why|when|where|who|which)') and not contains(text, '?') then 0.85 else 1.0 end)
    * greatest(0.5, 1 - 0.1 * (contains(lower(text), 'something')::int + contains(lower(text), 'stuff')::int + contains(lower(text), 'things')::int + contains(lower(text), 'etc')::int + contains(lower(text), 'whatever')::int)) as clarity from benchmark""", "clarity")
def clarity(spark, d):
    return t(spark, d, "benchmark").select("item_id", texts.clarity(F.col("text")).alias("clarity"))


@query("completeness", "select doc_id, case when length(trim(text)) = 0 then 0 when length(trim(text)) < 10 then 0.3 when length(trim(text)) < 50 then 0.6 when length(trim(text)) < 200 then 0.85 else 1 end as completeness from documents", "completeness")
def completeness(spark, d):
    return t(spark, d, "documents").select("doc_id", texts.completeness(F.col("text")).alias("completeness"))


def _task_sql(c: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains(lower({c}), '{p}')" for p in ps) + f" then '{k}'" for k, ps in texts.TASKS.items()) + " else 'other' end"


@query("task_diversity", f"with k as (select {_task_sql('instruction')} as task, count(*) as n from ({PAIRS}) group by 1) select sum(-(n / s) * log2(n / s)) / log2(11) as task_diversity, count(*) as kinds from k, (select sum(n) as s from k)", "task_diversity")
def task_diversity(spark, d):
    return texts.task_diversity(pairs(spark, d))


@query("lexical_diversity", "with w as (select unnest(regexp_split_to_array(lower(text), '\\s+')) as w from documents), c as (select count(*) as tokens, count(distinct w) as types from w where w <> '') select tokens, types, types / tokens as ttr, types / sqrt(tokens) as root_ttr, least(1, types / sqrt(tokens) / 30) as score from c", "ttr root_ttr score")
def lexical_diversity(spark, d):
    return texts.lexical_diversity(t(spark, d, "documents"), ["text"])


def _hits(test) -> str:
    return " + ".join(test(c) for c in ("instruction", "response"))


METRICS = f"""with p as ({PAIRS}), m as (select avg((case when length(instruction) < 10 then 0.5 when length(instruction) > 2000 then 0.8 else 1.0 end) * (case when regexp_matches(rtrim(instruction), '[.?!]$') then 1.0 else 0.9 end) * (case when regexp_matches(trim(lower(instruction)), '^({'|'.join(texts.QUESTION_WORDS)})') and not contains(instruction, '?') then 0.85 else 1.0 end)
      * greatest(0.5, 1 - 0.1 * ({' + '.join(f"contains(lower(instruction), '{v}')::int" for v in texts.VAGUE)}))) as clarity,
    avg(case when length(trim(response)) = 0 then 0 when length(trim(response)) < 10 then 0.3 when length(trim(response)) < 50 then 0.6 when length(trim(response)) < 200 then 0.85 else 1 end) as completeness,
    1 - sum({_hits(lambda c: f"coalesce({_any(f'lower({c})', texts.TOXIC_TERMS)}, false)::int")}) / (count(instruction) + count(response)) as toxicity,
    1 - least(1, 10 * sum({_hits(lambda c: ' + '.join(f"coalesce({_any(c, [p])}, false)::int" for p in texts.PII_RATE))}) / (count(instruction) + count(response))) as pii,
    1 - (0.4 * (1 - count(distinct instruction) / count(*)) + 0.2 * (1 - count(distinct response) / count(*)) + 0.4 * (1 - count(distinct (instruction, response)) / count(*))) as duplicates from p), s as (select *, 100 * (1.5 * clarity + 1.5 * completeness + 2 * toxicity + 2 * pii + duplicates) / 8 as score from m)
    select *, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as grade from s"""


@query("instruction_metrics", METRICS, "clarity completeness toxicity pii duplicates score")
def instruction_metrics(spark, d):
    return texts.instruction_metrics(pairs(spark, d))


@query("script_language", "select doc_id, case when regexp_matches(text, '[一-鿿]') then 'zh' when regexp_matches(text, '[぀-ヿ]') then 'ja' when regexp_matches(text, '[가-힯]') then 'ko' when regexp_matches(text, '[؀-ۿ]') then 'ar' when regexp_matches(text, '[Ѐ-ӿ]') then 'ru' else 'en' end as script from documents")
def script_language(spark, d):
    return t(spark, d, "documents").select("doc_id", texts.script_language(F.col("text")).alias("script"))


@query("caption_issues", "select page_id, unnest(list_filter([case when trim(html) = '' then 'missing_caption' when length(trim(html)) < 10 then 'short_caption' when length(trim(html)) > 500 then 'long_caption' end, case when url = '' then 'missing_image' when not regexp_matches(url, '^(data:|https?://)') then 'bad_image' end], lambda x: x is not null)) as issue from pages")
def caption_issues(spark, d):
    return texts.caption_issues(t(spark, d, "pages"), "page_id", "url", "html")


@query("cross_lingual", "select count(*) as matched, avg((a.quality = b.predicted)::int) as consistent from labels a join (select doc_id, (n_chars > 200)::int as predicted from documents where lang <> 'en') b using (doc_id)", "consistent")
def cross_lingual(spark, d):
    guesses = t(spark, d, "documents").where("lang <> 'en'").select("doc_id", (F.col("n_chars") > 200).cast("int").alias("quality"))
    return texts.cross_lingual(t(spark, d, "labels"), guesses, "doc_id", "quality")


def _pii_sql(table: str) -> str:
    parts = [f"""select doc_id, 'text' as "column", '{k}' as pii_type, unnest(regexp_extract_all(text, '(?i){p}')) as value, {c}::double as confidence from {table}""" for k, (ps, c) in privacy.PII.items() for p in ps]
    return " union all ".join(parts)


@query("pii_scan", _pii_sql("documents"))
def pii_scan(spark, d):
    return privacy.scan(t(spark, d, "documents"), "doc_id", ["text"])


@query("pii_columns", f"""select "column", count(distinct pii_type) as kinds, count(*) as matches, count(distinct pii_type) >= 2 or bool_or(pii_type in ('ssn', 'credit_card')) as high_risk from ({_pii_sql('documents')}) group by 1""")
def pii_columns(spark, d):
    return privacy.columns_at_risk(privacy.scan(t(spark, d, "documents"), "doc_id", ["text"]))


def _redact_sql(c: str) -> str:
    for k, (patterns, _) in privacy.PII.items():
        for p in patterns:
            c = f"regexp_replace({c}, '(?i){p}', '[{k.upper()}_REDACTED]', 'g')"
    return c


@query("pii_redact", f"select doc_id, md5({_redact_sql('text')}) as text_md5 from documents")
def pii_redact(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(privacy.redact(F.col("text"))).alias("text_md5"))


@query("pii_mask", "select c_custkey, case when length(c_name) <= 4 then repeat('*', length(c_name)) else repeat('*', length(c_name) - 4) || right(c_name, 4) end as masked, 'HASH_' || substr(sha256('pepper' || c_name), 1, 16) as hashed, 'TOK_' || substr(sha256('pepper|' || c_name), 1, 12) as token from customer")
def pii_mask(spark, d):
    c = F.col("c_name")
    return t(spark, d, "customer").select("c_custkey", privacy.mask(c).alias("masked"), privacy.hashed(c, "pepper").alias("hashed"), privacy.token(c, "pepper").alias("token"))


@query("pii_generalise", f"select doc_id, value, '*@' || split_part(value, '@', 2) as general from (select doc_id, unnest(regexp_extract_all(text, '(?i){EMAIL}')) as value from documents)")
def pii_generalise(spark, d):
    found = privacy.scan(t(spark, d, "documents"), "doc_id", ["text"], kinds={"email": privacy.PII["email"]})
    return found.select("doc_id", "value", privacy.generalise(F.col("value"), "email").alias("general"))


@query("pii_round_trip", "select doc_id, md5(text) as text_md5 from documents")
def pii_round_trip(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    tokens = privacy.token_map(privacy.scan(docs, "doc_id", ["text"], kinds={"email": privacy.PII["email"]}), "pepper")
    return privacy.detokenise(privacy.tokenise(docs, "text", privacy.any_case(EMAIL), "pepper"), "doc_id", "text", tokens).select("doc_id", F.md5("text").alias("text_md5"))


COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query("vector_search", f"select b.vec_id, {COS} as score from embeddings a, embeddings b where a.vec_id = 0 and b.label = 1 order by round(score, 9) desc, b.vec_id limit 10", "score")
def vector_search(spark, d):
    e = t(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return vectors.search(e, "vec_id", "embedding", q, 10, "cosine", "label = 1")


def neighbours(spark, d, k=10):
    e = t(spark, d, "embeddings")
    return vectors.top_k(e, e, "vec_id", "embedding", k)


NEAR = f"select a.vec_id as query, b.vec_id as key, {COS} as similarity, row_number() over (partition by a.vec_id order by {COS} desc, b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id"


@query("vector_neighbours", f"select query, key, similarity, rank::int as rank from ({NEAR}) where rank <= 10", "similarity")
def vector_neighbours(spark, d):
    return neighbours(spark, d)


# every vector and one a little off it
DOUBLED = "select vec_id, embedding::double[] as v from embeddings union all select -1 - vec_id, list_transform(embedding::double[], lambda x: x + 0.001) from embeddings"
LINKED = "select a.vec_id as key1, b.vec_id as key2, list_cosine_similarity(a.v, b.v) as similarity from ({0}) a join ({0}) b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) >= {1}"


def doubled(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.unionByName(e.select((-1 - F.col("vec_id")).alias("vec_id"), F.transform("v", lambda x: x + 0.001).alias("v")))


@query("vector_duplicates", LINKED.format(DOUBLED, 0.95), "similarity")
def vector_duplicates(spark, d):
    return vectors.near_pairs(doubled(spark, d), "vec_id", "v", 0.95)


@query("vector_outliers", f"with s as (select query as key, avg(1 - similarity) as score from ({NEAR}) where rank <= 10 group by 1) select key, score, row_number() over (order by score desc, key) <= (select greatest(1, floor(count(*) * 0.1)) from s) as is_outlier from s", "score")
def vector_outliers(spark, d):
    return vectors.outliers(neighbours(spark, d))


@query("vector_quality", f"select 2 * (select count(*) from embeddings) as vectors, (select count(*) from ({LINKED.format(DOUBLED, 0.95)})) as duplicate_pairs, greatest(1, floor(2 * (select count(*) from embeddings) * 0.1))::bigint as outliers")
def vector_quality(spark, d):
    both = doubled(spark, d)
    return vectors.quality(both, "vec_id", "v", vectors.top_k(both, both, "vec_id", "v", 10))


@query("vector_upsert", "select vec_id, case when vec_id < 10 then -1 else label end as label from embeddings where vec_id % 50 <> 49")
def vector_upsert(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label")
    new = e.where("vec_id < 10").withColumn("label", F.lit(-1))
    return vectors.delete(vectors.upsert(e, new, "vec_id"), e.where("vec_id % 50 = 49"), "vec_id")


@query("embedding_pairs", LINKED.format(DOUBLED, 0.97), "similarity")
def embedding_pairs(spark, d):
    return vectors.near_pairs(doubled(spark, d), "vec_id", "v", 0.97)


@query("pair_similarity", f"select a.vec_id as key1, b.vec_id as key2, {COS} as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1", "similarity")
def pair_similarity(spark, d):
    e = t(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("key1"), (F.col("vec_id") + 1).alias("key2"))
    return duplicates.similarity_of(p, e, "vec_id", "embedding")


@query("principal_components")
def principal_components(spark, d):
    return vectors.principal_components(t(spark, d, "embeddings"), "vec_id", "embedding")


@query("vector_clusters")
def vector_clusters(spark, d):
    return vectors.clusters(t(spark, d, "embeddings"), "vec_id", "embedding")


@query("heat_grid", "with e as (select min(c_acctbal) x0, max(c_acctbal) x1, min(c_nationkey) y0, max(c_nationkey) y1 from customer) select least(9, floor((c_acctbal - x0) / ((x1 - x0) / 10)))::int as cell_x, least(9, floor((c_nationkey - y0) / ((y1 - y0) / 10)))::int as cell_y, count(*) as n, avg(c_custkey) as mean from customer, e group by 1, 2", "mean")
def heat_grid(spark, d):
    return vectors.heat_grid(t(spark, d, "customer"), "c_acctbal", "c_nationkey", "c_custkey", 10)


@query("cosine_scalar", "select vec_id, list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]) as s from embeddings", "s")
def cosine_scalar(spark, d):
    return t(spark, d, "embeddings").select("vec_id", cosine(F.col("embedding"), F.reverse("embedding")).alias("s"))
