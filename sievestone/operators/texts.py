"""Checks of instruction, response and document texts by rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from .privacy import PII

# Word lists and patterns of the rules. All fillers are in lower case, as they are looked for in lower-case text.
REFUSAL_PREFIXES = ["i cannot", "i can't", "i'm not able", "i am not able", "as an ai", "as a language model", "i don't have"]
TOXIC = [r"(?i)\b(hate|kill|murder|attack|destroy)\b.*\b(people|person|group|them)\b", r"(?i)\b(stupid|idiot|moron|dumb)\b", r"(?i)\b(racist|sexist|bigot)\b"]
HARMFUL = [r"how to (make|create|build) (a )?bomb", r"how to (hack|crack|break into)", r"how to (steal|commit fraud)"]
INJECTION = [r"(?i)ignore (all )?(previous|prior|above) (instructions|prompts|rules)", r"(?i)disregard (all )?(previous|prior) (instructions|context)", r"(?i)you are now", r"(?i)act as (a |an )?(different|new)", r"(?i)pretend (to be|you are)", r"(?i)override (your |the )?(system|instructions)", r"(?i)jailbreak", r"(?i)DAN|do anything now"]
JAILBREAK = [r"(?i)hypothetically speaking", r"(?i)for (educational|research|fictional) purposes", r"(?i)in a (fictional|hypothetical|alternate) (world|scenario|universe)", r"(?i)roleplay as", r"(?i)no (ethical|moral) (guidelines|constraints|limitations)"]
REFUSAL = [r"(?i)^(I('m| am)? )?(sorry,? )?(but )?(I )?(can't|cannot|won't|will not)", r"(?i)^(as an AI|as a language model)", r"(?i)I('m| am)? not able to", r"(?i)I don't have (the ability|access)"]
UNCERTAIN = ["i'm not sure", "i believe", "it's possible", "may", "might", "could be", "i think"]
OVERCONFIDENT = r"(?i)definitely|certainly|always|never|100%|guaranteed|proven fact"
FILLERS = ["basically", "actually", "literally", "you know", "like", "um", "uh", "well", "so", "just", "i mean", "kind of", "sort of"]
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "be", "to", "of", "and", "in", "on", "at", "for", "with", "that", "this", "it", "as", "by", "from", "or"]
LEAKS = [PII[kind][0][0] for kind in ("email", "phone", "ssn", "credit_card", "ip_address")]
SCORED_TOXIC = [r"(?i)\b(shit|damn|hell|crap)\b", r"(?i)\b(kill|murder|attack|hurt) (you|them|him|her)\b", r"(?i)(going to|gonna) (hurt|kill|attack)", r"(?i)(you('re| are)) (stupid|dumb|idiot)", r"(?i)(shut up|go away|leave me alone)"]
TOXIC_TERMS = [r"\b(hate|kill|die|stupid|idiot|dumb)\b", r"\b(racist|sexist|homophobic)\b"]
QUESTION_WORDS = ["what", "how", "why", "when", "where", "who", "which"]
VAGUE = ["something", "stuff", "things", "etc", "whatever"]
TASKS = {
    "question_answering": ["what is", "what are", "who is", "when did", "where is"],
    "summarization": ["summarize", "summary", "brief", "tldr"],
    "translation": ["translate", "translation", "in english", "in spanish"],
    "code": ["write code", "function", "implement", "debug", "code that"],
    "creative": ["write a story", "write a poem", "creative", "imagine"],
    "analysis": ["analyze", "analysis", "evaluate", "assess"],
    "explanation": ["explain", "how does", "why does", "describe how"],
    "instruction": ["how to", "steps to", "guide", "tutorial"],
    "comparison": ["compare", "difference between", "versus", "vs"],
    "classification": ["classify", "categorize", "which category"],
}
PII_RATE = [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"]
SCRIPTS = [("zh", "一", "鿿"), ("ja", "぀", "ヿ"), ("ko", "가", "힯"), ("ar", "؀", "ۿ"), ("he", "֐", "׿"), ("ru", "Ѐ", "ӿ"), ("th", "฀", "๿"), ("hi", "ऀ", "ॿ")]
SEMANTIC_NAMES = [("email", r"email|e-mail|mail"), ("phone", r"phone|tel|mobile|cell"), ("name", r"name|first.*name|last.*name|full.*name"), ("address", r"address|street|city|state|zip|postal"), ("date", r"date|time|created|updated|timestamp"), ("id", r"_id$|^id$|identifier|uuid|guid"), ("url", r"url|link|website|href"), ("currency", r"price|cost|amount|total|salary"), ("percentage", r"percent|pct|rate|ratio")]
SEMANTIC_VALUES = [("email", r"@.*\."), ("phone", r"^\+?\d[\d\s\-\(\)]{7,}$"), ("url", r"^https?://"), ("currency", r"^\$?\d+\.?\d*$"), ("percentage", r"^\d+\.?\d*%?$")]


def any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [c.rlike(p) for p in patterns])


def any_within(c: Column, phrases: list[str]) -> Column:
    return reduce(Column.__or__, [c.contains(p) for p in phrases])


def occurrences(c: Column, phrase: str) -> Column:
    """How often a phrase occurs, occurrences not overlapping."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def words(c: Column) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, instruction, response: every user turn and the assistant's turn after it."""
    a = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    b = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return a.join(b, ["conv_id", "turn"])


def length_issues(df: DataFrame, key: list[str], column: str, least: int = 10, most: int = 10_000) -> DataFrame:
    """key, issue, severity of texts too short (high if under 5 characters) or too long."""
    n = F.length(F.coalesce(F.col(column), F.lit("")))
    issue = F.when(n < least, "too_short").when(n > most, "too_long")
    level = F.when(n < 5, "high").otherwise("medium")
    return df.select(*key, issue.alias("issue"), level.alias("severity")).where("issue is not null")


def coherence_issues(df: DataFrame, key: list[str], instruction: str = "instruction", response: str = "response") -> DataFrame:
    """key, issue: the first of repetition (response within the instruction), refusal by prefix, empty (under 3 characters)."""
    i, r = (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in (instruction, response))
    refusal = reduce(Column.__or__, [r.startswith(p) for p in REFUSAL_PREFIXES])
    issue = F.when((F.length(r) > 0) & i.contains(r), "repetition").when(refusal, "refusal").when(F.length(r) < 3, "empty")
    return df.select(*key, issue.alias("issue")).where("issue is not null")


def format_issues(df: DataFrame, key: list[str], response: str = "response") -> DataFrame:
    """key, issue, confidence: a response that breaks off (ends in dots) or has an odd number of code fences."""
    r = F.coalesce(F.col(response), F.lit(""))
    end = F.rtrim(r)
    found = F.array_compact(F.array(
        F.when(end.endswith("...") | end.endswith("…"), F.struct(F.lit("truncated").alias("issue"), F.lit(0.7).alias("confidence"))),
        F.when(occurrences(r, "```") % 2 == 1, F.struct(F.lit("format_error").alias("issue"), F.lit(0.8).alias("confidence"))),
    ))
    return df.select(*key, F.inline(found))


def instruction_report(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """issue, n over all kinds of checks of instruction and response pairs, repeated instructions too."""
    repeats = df.groupBy(F.md5(F.coalesce("instruction", F.lit(""))).alias("h")).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("issue"), "n")
    kinds = length_issues(df, key, "response").select("issue").unionByName(coherence_issues(df, key).select("issue")).unionByName(format_issues(df, key).select("issue"))
    return kinds.groupBy("issue").agg(F.count("*").alias("n")).unionByName(repeats.where("n > 0"))


def instruction_issues(df: DataFrame, key: str, instruction: str = "instruction", response: str = "response", kinds: tuple[str, ...] = ("duplicate", "length", "coherence", "format"), least: int = 10) -> DataFrame:
    """key, issue: instructions that repeat the one of a smaller key, and length, coherence and format of responses, as far as ``kinds`` asks for them."""
    from .duplicates import pointers

    parts = []
    if "duplicate" in kinds:
        parts.append(pointers(df.select(key, F.coalesce(F.col(instruction), F.lit("")).alias("i")), key, ["i"]).select(key, F.lit("duplicate").alias("issue")))
    if "length" in kinds:
        parts.append(length_issues(df, [key], response, least).select(key, "issue"))
    if "coherence" in kinds:
        parts.append(coherence_issues(df, [key], instruction, response).select(key, "issue"))
    if "format" in kinds:
        parts.append(format_issues(df, [key], response).select(key, "issue"))
    return reduce(DataFrame.unionByName, parts)


def passage_issues(df: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = ("duplicate", "length"), least: int = 10) -> DataFrame:
    """key, issue of the passages of a retrieval corpus: repeats of one with a smaller key, and texts too short."""
    from .duplicates import pointers

    parts = []
    if "duplicate" in kinds:
        parts.append(pointers(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("i")), key, ["i"]).select(key, F.lit("duplicate").alias("issue")))
    if "length" in kinds:
        parts.append(length_issues(df, [key], text, least).where("issue = 'too_short'").select(key, "issue"))
    return reduce(DataFrame.unionByName, parts)


def cleaned(df: DataFrame, key: str, issues: DataFrame, drop: tuple[str, ...] = ("duplicate", "too_short")) -> DataFrame:
    """The table without rows that have an issue of the kinds to drop. Incoherent pairs are those with repetition, refusal or empty."""
    gone = issues.where(F.col("issue").isin(*drop)).select(F.col(key).alias("gone")).distinct()
    return df.join(gone, df[key] == gone["gone"], "left_anti")


def issue_summary(df: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: n_samples, n_issues, duplicate_rate, short_rate, coherence, quality (1 less issues a row, not below 0)."""
    n = df.agg(F.count("*").alias("n_samples"))
    k = lambda *names: F.count_if(F.col("issue").isin(*names))
    found = issues.agg(F.count("*").alias("n_issues"), k("duplicate").alias("d"), k("too_short").alias("s"), k("repetition", "refusal", "empty").alias("c"))
    rate = lambda c: ratio(F.col(c), F.col("n_samples"))
    return n.crossJoin(found).select("n_samples", "n_issues", rate("d").alias("duplicate_rate"), rate("s").alias("short_rate"), (1 - rate("c")).alias("coherence"), F.greatest(F.lit(0.0), 1 - rate("n_issues")).alias("quality"))


def helpfulness(instruction: Column, response: Column) -> Column:
    n = F.length(response)
    fill = ratio(reduce(Column.__add__, [occurrences(F.lower(response), p) for p in FILLERS]), F.size(words(F.lower(response))))
    asked = F.array_except(F.array_distinct(words(F.lower(instruction))), F.array(*map(F.lit, STOP_WORDS)))
    met = F.size(F.array_intersect(asked, words(F.lower(response)))) / F.greatest(F.size(asked), F.lit(1))
    answered = (F.size(asked) == 0) | (met > 0.1)
    score = F.when(n < 20, 0.3).when(n < 50, 0.6).otherwise(1.0)
    return score * F.when(fill > 0.5, 0.7).otherwise(1.0) * F.when(answered, 1.0).otherwise(0.5) * F.when(any_match(response, REFUSAL), 0.8).otherwise(1.0)


def harmlessness(response: Column) -> Column:
    return F.when(any_match(response, TOXIC), 0.3).otherwise(1.0) * F.when(any_match(response, LEAKS), 0.5).otherwise(1.0) * F.when(any_match(F.lower(response), HARMFUL), 0.2).otherwise(1.0)


def honesty(response: Column) -> Column:
    return F.when(response.rlike(OVERCONFIDENT) & ~any_within(F.lower(response), UNCERTAIN), 0.8).otherwise(1.0)


def evaluate_responses(df: DataFrame, key: list[str], instruction: str = "instruction", response: str = "response") -> DataFrame:
    """key, helpfulness, harmlessness, honesty, overall (.4, .4, .2), injection, jailbreak."""
    i, r = (F.coalesce(F.col(c), F.lit("")) for c in (instruction, response))
    scored = df.select(*key, helpfulness(i, r).alias("helpfulness"), harmlessness(r).alias("harmlessness"), honesty(r).alias("honesty"), any_match(i, INJECTION).alias("injection"), any_match(i, JAILBREAK).alias("jailbreak"))
    return scored.withColumn("overall", F.expr("0.4 * helpfulness + 0.4 * harmlessness + 0.2 * honesty"))


def toxicity(c: Column) -> Column:
    """min(1, 10 matches / words)."""
    matches = reduce(Column.__add__, [F.regexp_count(c, F.lit(p)) for p in SCORED_TOXIC])
    some = c.rlike("|".join(f"(?:{p})" for p in SCORED_TOXIC))  # texts without a match see one pattern, and no words are counted
    return F.when(c.isNull(), None).when(some, F.least(F.lit(1.0), 10.0 * matches / F.greatest(F.size(words(c)), F.lit(1)))).otherwise(0.0)


def clarity(c: Column) -> Column:
    n, low = F.length(c), F.lower(c)
    score = F.when(n < 10, 0.5).when(n > 2000, 0.8).otherwise(1.0)
    ends = F.rtrim(c).rlike(r"[.?!]$")
    asks = reduce(Column.__or__, [F.trim(low).startswith(w) for w in QUESTION_WORDS])
    vague = reduce(Column.__add__, [low.contains(t).cast("int") for t in VAGUE])
    return score * F.when(ends, 1.0).otherwise(0.9) * F.when(asks & ~c.contains("?"), 0.85).otherwise(1.0) * F.greatest(F.lit(0.5), 1 - vague * 0.1)


def completeness(c: Column) -> Column:
    n = F.length(F.trim(c))
    return F.when(n == 0, 0.0).when(n < 10, 0.3).when(n < 50, 0.6).when(n < 200, 0.85).otherwise(1.0)


def task(c: Column) -> Column:
    low, out = F.lower(c), None
    for name, phrases in TASKS.items():
        test = any_within(low, phrases)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def task_diversity(df: DataFrame, instruction: str = "instruction") -> DataFrame:
    """Entropy (base 2) of task kinds over the largest possible; 0 for one kind."""
    counts = df.where(F.col(instruction).isNotNull()).groupBy(task(F.col(instruction)).alias("task")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).agg((F.sum(-p * F.log2(p)) / F.log2(F.lit(float(len(TASKS) + 1)))).alias("task_diversity"), F.count("*").alias("kinds"))


def lexical_diversity(df: DataFrame, columns: list[str]) -> DataFrame:
    """tokens, types, ttr, root_ttr, score = min(1, root_ttr / 30) over all words of the columns."""
    tokens = df.select(F.explode(F.flatten(F.array(*[words(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in columns]))).alias("w"))
    counts = tokens.groupBy("w").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"))
    return counts.select("tokens", "types", ratio(F.col("types"), F.col("tokens")).alias("ttr"), ratio(F.col("types"), F.sqrt("tokens")).alias("root_ttr"), F.least(F.lit(1.0), ratio(F.col("types"), F.sqrt("tokens")) / 30).alias("score"))


def instruction_metrics(df: DataFrame) -> DataFrame:
    """One row: clarity, completeness, toxicity (1 - rate), pii (1 - min(1, 10 hits / texts)), duplicates, weighted score, grade."""
    i, r = F.col("instruction"), F.col("response")
    texts = F.count("instruction") + F.count("response")
    toxic = reduce(Column.__add__, [F.count_if(any_match(F.lower(c), TOXIC_TERMS)) for c in (i, r)])
    hits = reduce(Column.__add__, [F.count_if(c.rlike(p)) for c in (i, r) for p in PII_RATE])
    main = df.agg(F.avg(clarity(i)).alias("clarity"), F.avg(completeness(r)).alias("completeness"), (1 - ratio(toxic, texts)).alias("toxicity"), (1 - F.least(F.lit(1.0), 10 * ratio(hits, texts))).alias("pii"))
    rate = lambda *c: df.groupBy(*c).agg(F.count("*").alias("n")).agg((1 - F.count("*") / F.sum("n")).alias("rate"))
    a, b, c = rate("instruction"), rate("response"), rate("instruction", "response")
    copies = a.crossJoin(b.withColumnRenamed("rate", "rb")).crossJoin(c.withColumnRenamed("rate", "rc")).select((1 - (0.4 * F.col("rate") + 0.2 * F.col("rb") + 0.4 * F.col("rc"))).alias("duplicates"))
    from .scores import grade

    out = main.crossJoin(copies).withColumn("score", F.expr("100 * (1.5 * clarity + 1.5 * completeness + 2 * toxicity + 2 * pii + duplicates) / 8"))
    return out.withColumn("grade", grade(F.col("score")))


def script_language(c: Column) -> Column:
    """The language of the first script, in a fixed order, that a text has characters of; else en."""
    out = None
    for lang, low, high in SCRIPTS:
        test = c.rlike(f"[{low}-{high}]")
        out = F.when(test, lang) if out is None else out.when(test, lang)
    return out.otherwise("en")


def semantic_types(df: DataFrame) -> dict[str, str | None]:
    """Of each column, the kind its name tells, else the one that over 80 % of its values fit."""
    import re

    named = {c: next((k for k, p in SEMANTIC_NAMES if re.search(p, c.lower())), None) for c in df.columns}
    open_columns = [c for c, kind in named.items() if kind is None]
    if open_columns:
        row = df.agg(*[F.avg(F.col(c).cast("string").rlike(p).cast("int")).alias(f"{i}_{k}") for i, c in enumerate(open_columns) for k, p in SEMANTIC_VALUES]).first()
        for i, c in enumerate(open_columns):
            named[c] = next((k for k, _ in SEMANTIC_VALUES if (row[f"{i}_{k}"] or 0) > 0.8), None)
    return named


def cross_lingual(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """matched, consistent: rows of both tables by key and the share of equal labels."""
    x = a.select(key, F.col(label).alias("x"))
    return x.join(b.select(key, F.col(label).alias("y")), key).agg(F.count("*").alias("matched"), F.avg(F.col("x").eqNullSafe(F.col("y")).cast("int")).alias("consistent"))


def caption_issues(df: DataFrame, key: str, image: str, caption: str, least: int = 10, most: int = 500) -> DataFrame:
    """key, issue of image and caption pairs: missing or unusable images, missing, short, long or generic captions."""
    text, uri = F.trim(F.coalesce(F.col(caption), F.lit(""))), F.coalesce(F.col(image), F.lit(""))
    known = uri.rlike(r"(?i)\.(jpg|jpeg|png|gif|bmp|webp)$") | uri.rlike(r"^(data:|https?://)")
    found = F.array_compact(F.array(
        F.when(uri == "", "missing_image").when(~known, "bad_image"),
        F.when(text == "", "missing_caption").when(F.length(text) < least, "short_caption").when(F.length(text) > most, "long_caption"),
        F.when(F.lower(text).rlike(r"^(image of|picture of|photo of|an image|a picture|a photo)"), "generic_caption"),
    ))
    return df.select(key, F.explode(found).alias("issue"))
