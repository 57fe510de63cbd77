"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality
from .alignment import align_documents
from .common import Scratch
from .conversations import repair_conversations
from .decontamination import contamination
from .line_dedup import line_classes
from .minhash_dedup import NearDedup, minhash_dedup
from .packing import Packing, pack_documents
from .substring_dedup import repeated_passages
from .token_files import read_ids, write_ids
from .toxicity import score_toxicity
from .url_filter import judge_urls
from .vector_search import nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies. Null and wordless texts: size 0, alone. Null ids: null component, kept. Repeated ids: documents of their own. Empty table: no rows."""
    return minhash_dedup(table(spark, sf_dir, "documents"), NearDedup(words=2)).select("doc_id", "n_shingles", "component_id", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written to files and read back. Null texts: the end id alone. Null ids come first, rows of one id in the order of their code. Empty table: no rows."""
    scratch = Scratch(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), scratch.path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_ids(spark, scratch.path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Learnt from the rows outside the fold that op3 holds out."""
    return quality.train(docs, table(spark, sf_dir, "labels"), learn_from=remainder(4) != 2)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all rows. Null texts are empty, null ids not held out, repeated rows scored alike; without positives all scores are 0.5. Empty table: no rows."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours. Unsound vectors and null ids take no part; repeated ids are candidates of their own, but no row of the query's id is. Empty table: no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10, relax=1.0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all rows, judged row by row, null and repeated ids too. Null texts have no words; items without id or words no windows. Empty benchmark: no hits."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that an earlier place has too. Null and empty texts have none; null ids rank last; different texts of one id keep what they share. Empty table: no rows."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all rows. Null texts and texts without a letter: und, score 0. Null ids are not held out; without a language to learn from all are und. Empty table: no rows."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(remainder(3) != 1).select("text", "lang"))
    found = language_id.predict(docs, model)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.transform("languages", lambda x: F.concat_ws(":", x["lang"], F.round(x["share"], 4).cast("string"))).alias("languages"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all rows. Null URLs and those without :// have empty host and path and the default verdict; repeated rows are judged alike. Empty table: no rows."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all rows. Null texts: the end id alone. Null ids stay null, repeated rows are documents of their own. Empty table: no rows."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges of conversations, an assistant's turn after the turn before it, packed with loss on the assistant's tokens.

    A sequence has at most 2048 tokens, 8 exchanges and 1024 tokens with loss. The
    prompt is the text of the turn numbered one less (the smallest, where rows
    repeat a turn; none, where there is none or conv_id is null). Null roles are
    no assistant's, null texts are empty.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    before = turns.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    exchanges = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left")
    pieces = pack_documents(exchanges, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, params=Packing(segments=8, loss_tokens=1024), id_col="conv_id", prompt_col="prompt")
    return pieces.select(F.col("doc_id").alias("conv_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all lines that are not blank. Null and empty texts have no lines; null ids come last; texts of one id are told apart. Empty table: no rows."""
    return line_classes(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all rows. Null texts are empty, null ids not held out, repeated rows scored alike; without toxic and other labels all scores are their share. Empty table: no rows."""
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=remainder(3) != 1)
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of all rows. Null and empty texts, and those whose tokens' bytes are not the text's: zeros. Null and repeated ids are documents of their own. Empty table: no rows."""
    found, _ = align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.drop("groups")


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with a fifth of their turns spoilt, by crc32 of conv_id:turn: dropped, emptied, cut of stops, repeated, given to the user. Nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("time")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all conversations after damage. Null roles and texts are one space, a null conv_id is a conversation, repeated turns are duplicates; one without turns after damage has zeros, no edits and the digest of nothing. Empty table: no rows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, _ = repair_conversations(damage(turns))
    every = turns.select(F.col("conv_id").alias("of")).distinct()
    out = every.join(found, every["of"].eqNullSafe(found["conv_id"]), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("of").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pack_conversations": pack_conversations}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_SQL = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) when len(w) = 1 then w else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
b as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from b join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.b) as component_id, d.doc_id = min(r.b) as kept from documents d left join n on n.doc_id = d.doc_id join r on r.a = d.doc_id group by d.doc_id, n.n"""

NEAREST_SQL = """with v as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select a.vec_id as query_id, b.vec_id, sqrt(list_reduce(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d) where rank <= 10"""

HITS_SQL = f"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
b as (select distinct item_id, least(10, len(w)) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: list_aggregate(w[k:k + 9], 'string_agg', ' '))) as g from i where len(w) > 0),
d as (select doc_id, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) as k, w from w, (select distinct n from b)),
h as (select doc_id, d.n, k, item_id from d join b on b.n = d.n and b.g = list_aggregate(w[k:k + d.n - 1], 'string_agg', ' ')),
p as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(k, k + n)) as x from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by 1)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from w left join p using (doc_id) left join t using (doc_id)"""

URL_SQL = f"""with x as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
y as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from x), z as (select page_id, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from y),
r as (select * from (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}) r(rule_host, rule_path, verdict)),
m as (select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(verdict, length(rule_host || rule_path)) as verdict from z join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by 1)
select z.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from z left join m using (page_id)"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, models, anchors and fuzzy lines are tested against brute force instead."""
    return {"op1_minhash_near_dedup": NEAR_SQL, "op4_nearest_neighbours": NEAREST_SQL, "op6_decontamination": HITS_SQL, "op9_url_filter": URL_SQL}
