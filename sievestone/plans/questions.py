"""Questions in plain words about issue tables, as DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTENTS = [("summary", r"summar|overview|overall|total"), ("list", r"show|list|find|get|display|what are"), ("filter", r"filter|only|where|with"), ("stats", r"how many|count|number of|statistic"), ("fix", r"fix|repair|remove"), ("export", r"export|save|download")]
KINDS = [("label_errors", r"label|mislabel"), ("duplicates", r"duplicat|repeat"), ("outliers", r"outlier|anomal"), ("imbalance", r"imbalance|class distribution"), ("bias", r"bias|fair")]


@dataclass(frozen=True)
class Question:
    intent: str
    kind: str | None
    limit: int | None = None
    confidence: float | None = None
    label: str | None = None
    descending: bool = True


def parse(text: str, before: Question | None = None) -> Question:
    """The first intent, in order, and issue kind that a text names; a kind not named is the one asked for before."""
    low = text.lower()
    intent = next((k for k, p in INTENTS if re.search(p, low)), "summary")
    kind = next((k for k, p in KINDS if re.search(p, low)), before.kind if before else None)
    limit = re.search(r"\b(?:top|first|limit)\s+(\d+)", low)
    confidence = re.search(r"(?:confidence|above|over|>=?)\s*(?:of|above|over|than|>=?)?\s*(\d+(?:\.\d+)?)\s*%?", low)
    value = float(confidence[1]) if confidence else 0.9 if "high confidence" in low else None
    label = re.search(r"class\s+['\"]?([\w-]+)", low)
    return Question(intent, kind, int(limit[1]) if limit else None, value / 100 if value and value > 1 else value, label[1] if label and label[1] != "distribution" else None, "lowest" not in low and "ascending" not in low)


def answer(question: Question, issues: dict[str, DataFrame]) -> DataFrame:
    """Rows of the issue table asked about, or counts of all issue tables."""
    if question.kind is None or question.kind not in issues or question.intent == "summary":
        parts = [df.agg(F.lit(k).alias("issue"), F.count("*").alias("n")) for k, df in issues.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    df = issues[question.kind]
    measure = next((c for c in ("confidence", "score", "similarity", "ratio") if c in df.columns), None)
    if question.confidence is not None and measure:
        df = df.where(F.col(measure) >= question.confidence)
    if question.label is not None and "given" in df.columns:
        df = df.where(F.lower(F.col("given").cast("string")) == question.label)
    if question.intent == "stats":
        return df.agg(F.lit(question.kind).alias("issue"), F.count("*").alias("n"))
    if measure:
        df = df.orderBy(F.desc(measure) if question.descending else F.asc(measure), *[c for c in df.columns if c != measure])
    return df.limit(question.limit or 10)
