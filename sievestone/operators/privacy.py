"""Personal data: scans, columns at risk, masking and its reversal."""

from __future__ import annotations

import bisect
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds, patterns, confidences.
PII = {
    "email": ([r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"], 0.95),
    "phone": ([r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"], 0.9),
    "ssn": ([r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"], 0.85),
    "credit_card": ([r"\b(?:\d{4}[-\s]?){3}\d{4}\b", r"\b\d{16}\b"], 0.9),
    "ip_address": ([r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"], 0.95),
    "date_of_birth": ([r"\b(?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b", r"\b(?:19|20)\d{2}[/\-](?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12]\d|3[01])\b"], 0.7),
    "passport": ([r"\b[A-Z]{1,2}\d{6,9}\b"], 0.6),
    "bank_account": ([r"\b\d{8,17}\b", r"\b\d{9}\b"], 0.5),
}


def any_case(pattern: str) -> str:
    """The pattern without regard to case, as all kinds are looked for."""
    return f"(?i){pattern}"


def scan(df: DataFrame, key: str, columns: list[str], least: float = 0.5, kinds: dict = PII) -> DataFrame:
    """key, column, pii_type, value, confidence: a row for each match of each pattern."""

    def matches(c: str, kind: str, pattern: str, confidence: float) -> Column:
        values = F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(any_case(pattern)), F.lit(0))
        return F.transform(values, lambda v: F.struct(F.lit(c).alias("column"), F.lit(kind).alias("pii_type"), v.alias("value"), F.lit(confidence).alias("confidence")))

    wanted = [(k, p, conf) for k, (patterns, conf) in kinds.items() if conf >= least for p in patterns]
    found = [matches(c, k, p, conf) for c in columns for k, p, conf in wanted]
    any_of = F.lit(any_case("|".join(f"(?:{p})" for _, p, _ in wanted)))  # rows without any match see one pattern, not all of them
    some = reduce(Column.__or__, [F.coalesce(F.rlike(F.col(c), any_of), F.lit(False)) for c in columns], F.lit(False))
    return df.where(some).select(key, F.inline(F.flatten(F.array(*found))))


def spans(df: DataFrame, key: str, columns: list[str], least: float = 0.5, kinds: dict = PII) -> DataFrame:
    """key, column, pii_type, start, end, value, confidence, overlaps: every match with its places, characters from 0.

    Matches of different patterns may overlap; ``overlaps`` counts the other
    matches of the cell that share a character with one. Cells are looked over
    by one joined pattern in the JVM first, and only those that it fits go on to
    the tasks' regular expressions. Null cells have no matches.
    """
    wanted = [(k, p, float(conf)) for k, (patterns, conf) in kinds.items() if conf >= least for p in patterns]
    any_of = any_case("|".join(f"(?:{p})" for _, p, _ in wanted))
    cells = df.select(F.col(key).alias("key"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns]))).where(F.col("text").rlike(any_of))
    kind = dict(df.dtypes)[key]

    def find(batches):
        compiled = [(k, re.compile(p, re.IGNORECASE | re.ASCII), conf) for k, p, conf in wanted]
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field(0).type), ("column", pa.string()), ("pii_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("confidence", pa.float64()), ("overlaps", pa.int32())])
            out: list[tuple] = []
            for i, column, text in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                found = sorted((m.start(), m.end(), k, m.group(), conf) for k, p, conf in compiled for m in p.finditer(text))
                starts, ends = [f[0] for f in found], sorted(f[1] for f in found)
                for s, e, k, value, conf in found:
                    # those that start before it ends, less those that end before it starts, less itself
                    out.append((i, column, k, s, e, value, conf, bisect.bisect_left(starts, e) - bisect.bisect_right(ends, s) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return cells.mapInArrow(find, f"key {kind}, column string, pii_type string, start int, end int, value string, confidence double, overlaps int").withColumnRenamed("key", key)


def columns_at_risk(found: DataFrame) -> DataFrame:
    """column, kinds, matches, high_risk: two kinds or more, or social security or card numbers."""
    g = found.groupBy("column").agg(F.count_distinct("pii_type").alias("kinds"), F.count("*").alias("matches"), F.max(F.col("pii_type").isin("ssn", "credit_card")).alias("grave"))
    return g.select("column", "kinds", "matches", ((F.col("kinds") >= 2) | F.col("grave")).alias("high_risk"))


def redact(c: Column, kinds: dict = PII) -> Column:
    """Matches replaced by [KIND_REDACTED], kind by kind."""
    return reduce(lambda out, x: F.regexp_replace(out, any_case(x[0]), f"[{x[1].upper()}_REDACTED]"), [(p, k) for k, (patterns, _) in kinds.items() for p in patterns], c)


def mask(c: Column) -> Column:
    """All but the last four characters starred; all of a value of four or fewer."""
    return F.when(F.length(c) <= 4, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(c) - 4), F.right(c, F.lit(4))))


def hashed(c: Column, salt: str) -> Column:
    return F.concat(F.lit("HASH_"), F.substring(F.sha2(F.concat(F.lit(salt), c), 256), 1, 16))


def token(c: Column, salt: str) -> Column:
    """A stand-in derived from the salted value, so that equal values get equal ones and retries repeat them."""
    return F.concat(F.lit("TOK_"), F.substring(F.sha2(F.concat(F.lit(salt), F.lit("|"), c), 256), 1, 12))


def generalise(c: Column, kind: str) -> Column:
    if kind == "email":
        return F.when(c.contains("@"), F.concat(F.lit("*@"), F.split_part(c, F.lit("@"), F.lit(2)))).otherwise("[EMAIL]")
    if kind == "phone":
        return F.when(F.length(c) >= 3, F.concat(F.lit("("), F.substring(c, 1, 3), F.lit(") ***-****"))).otherwise("[PHONE]")
    if kind == "date_of_birth":
        return F.when(F.length(c) >= 4, F.concat(F.right(c, F.lit(4)), F.lit("/**/**"))).otherwise("[DOB]")
    if kind == "ip_address":
        return F.concat_ws(".", F.split_part(c, F.lit("."), F.lit(1)), F.split_part(c, F.lit("."), F.lit(2)), F.lit("*"), F.lit("*"))
    return F.lit(f"[{kind.upper()}]")


def encrypted(c: Column, key: str) -> Column:
    """Base64 of AES in GCM mode; ``key`` has 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(c, F.lit(key)))


def token_map(found: DataFrame, salt: str) -> DataFrame:
    """token, value of every distinct match: the table that turns tokens back."""
    return found.select(token(F.col("value"), salt).alias("token"), "value").distinct()


def tokenise(df: DataFrame, column: str, pattern: str, salt: str) -> DataFrame:
    """Matches of a pattern in a column replaced by tokens; text between matches stays."""
    parts = F.split(F.col(column), pattern, -1)
    tokens = F.transform(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0)), lambda v: token(v, salt))
    woven = F.array_join(F.zip_with(parts, tokens, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return df.withColumn(column, woven)


def detokenise(df: DataFrame, key: str, column: str, tokens: DataFrame) -> DataFrame:
    """Texts with their tokens turned back, by a join on each token that occurs."""
    used = df.select(key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit("TOK_[0-9a-f]{12}"), F.lit(0))).alias("at", "token"))
    back = used.join(tokens, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("__values"))
    joined = df.join(back, key, "left")
    parts = F.split(F.col(column), "TOK_[0-9a-f]{12}", -1)
    woven = F.array_join(F.zip_with(parts, F.coalesce("__values", F.array().cast("array<struct<at:int,value:string>>")), lambda a, b: F.concat(a, F.coalesce(b["value"], F.lit("")))), "")
    return joined.select(*[woven.alias(c) if c == column else F.col(c) for c in df.columns])
