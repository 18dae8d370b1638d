"""Chat history and keyword routing of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Question keywords per intent, in order; the first intent with a hit wins.
INTENT_WORDS = {
    "why_non_compliant": ["why", "non-compliant", "fail", "violation", "ஏன்", "காரணம்", "क्यों", "కారణం"],
    "missing_fields": ["missing", "which", "விடுபட்ட", "छूटी", "ఏవి"],
    "mrp": ["mrp", "price", "விலை", "कीमत", "ధర"],
    "expiry": ["expire", "expiry", "date", "காலாவதி", "समाप्ति", "గడువు"],
    "consumer_rights": ["right", "consumer", "law", "சட்டம்", "அதிகாரம்", "कानून"],
    "compliant": ["compliant", "valid", "pass", "சரி"],
}
OTHER_INTENT = "default"


def intent_of(text: Column) -> Column:
    lowered = F.lower(F.trim(text))
    expr = F.lit(OTHER_INTENT)
    for intent, words in reversed(list(INTENT_WORDS.items())):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lowered, F.lit(word))
        expr = F.when(hit, intent).otherwise(expr)
    return expr


def route_messages(messages: DataFrame) -> DataFrame:
    return messages.withColumn("intent", intent_of(F.col("text")))


def intent_mix(messages: DataFrame) -> DataFrame:
    return (
        route_messages(messages.select("role", "text"))
        .groupBy("role", "intent")
        .agg(F.count(F.lit(1)).alias("message_count"))
    )


def chat_history(messages: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` messages of every session, oldest first."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
