"""The audit gate: the first rule that a labelled record breaks, or null.

Rules of single messages come first, message by message; then those of the set, the stage, the greeting and the mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COMPANY
from ..functions.text import any_of, first_word, has, sentence_count, strip
from .surrogates import ANY_TOKEN

RATE = r"(?i)\$\s?\d|\bAPR\b|\b\d+(?:\.\d+)?\s?%"
TOKEN = ANY_TOKEN
HARSH = r"(?i)\b(?:" + any_of("denied", "disqualified", "failed", "rejected") + r")\b"
HELLO = r"(?i)^\s*(?:hello|hey|hi)\b"
SCREEN = r"(?i)\b(?:appl(?:y|ication)|bankruptc|foreclosur|how do you plan (?:to |on )?us|investment property|late (?:mortgage )?payment|pre-?approv|primary residence|property)"
ACKNOWLEDGE = r"(?i)^\s*(?:hey\s+\w+[!,]?\s+)?(?:" + any_of("absolutely", "alright", "awesome", "glad to hear", "good to hear", "good to know", "got it", "gotcha", "great", "i understand", "makes sense", "no worries", "of course", "ok so", "okay so", "perfect", "sounds good") + r")\b"


def message_reason(message: Column, confidence: Column) -> Column:
    """First broken rule of one message. prompts.recommendations gives null for a message that isn't a string."""
    return (
        F.when(message.isNull() | (strip(message) == ""), F.lit("empty suggested_message"))
        .when(~F.coalesce(confidence.isin("high", "medium", "low"), F.lit(False)), F.concat(F.lit("bad confidence '"), F.coalesce(confidence, F.lit("")), F.lit("'")))
        .when(F.length(message) > 400, F.lit("message too long"))
        .when(sentence_count(message) > 3, F.lit("more than 3 sentences"))
        .when(has(message, RATE), F.lit("mentions rate/APR/$ amount"))
        .when(has(message, TOKEN), F.lit("contains a redaction placeholder token (e.g. {NAME})"))
    )


def reason(recs: Column, stage: Column, latest: Column, is_first: Column, mode: Column, company: str = COMPANY) -> Column:
    """First broken rule of a record. recs: array of suggested_message and confidence."""
    texts = F.transform(recs, lambda r: strip(r["suggested_message"]))
    any_text = lambda pattern: F.exists(texts, lambda m: has(m, pattern))
    count = F.when(recs.isNull(), F.lit("not exactly 3 recommendations (n/a)")).when(F.size(recs) != 3, F.concat(F.lit("not exactly 3 recommendations ("), F.size(recs).cast("string"), F.lit(")")))
    single = F.get(F.filter(F.transform(recs, lambda r: message_reason(r["suggested_message"], r["confidence"])), lambda x: x.isNotNull()), F.lit(0))
    whole = (
        F.when(F.size(F.array_distinct(F.transform(texts, first_word))) == 1, F.lit("all 3 start with the same word"))
        .when(F.size(F.filter(texts, lambda m: has(m, ACKNOWLEDGE))) >= 2, F.lit("2+ suggestions open with call-style acknowledgement filler"))
        .when((F.lower(stage) == "ineligible") & any_text(HARSH), F.lit("ineligible message uses forbidden word"))
        .when((F.lower(is_first) == "yes") & has(latest, HELLO) & F.exists(texts, lambda m: ~F.lower(m).contains(company.lower())), F.lit(f"greeting message missing '{company}'"))
        .when((mode == "empathy") & any_text(SCREEN), F.lit("empathy reply still qualifies/pitches (must not sell)"))
        .when((mode == "stop") & F.exists(texts, lambda m: m.contains("?") | (F.length(m) > 140)), F.lit("stop reply is not a clean, question-free acknowledgement"))
        .when(mode.isin("logistics", "objection", "other_lender") & any_text(SCREEN), F.concat(mode, F.lit(" reply pushes a screening question (should not)")))
    )
    return F.coalesce(count, single, whole)


def audited(labelled: DataFrame) -> DataFrame:
    """The rows with ``reject_reason`` (null: passed)."""
    return labelled.withColumn("reject_reason", reason(*[F.col(c) for c in ("recommendations", "stage", "latest", "is_first", "mode")]))


def pass_rate(rows: DataFrame) -> DataFrame:
    """One row: labelled, passed, rejected, percentage passed."""
    n, ok = F.count("*"), F.count_if(F.col("reject_reason").isNull())
    return rows.agg(n.alias("labelled"), ok.alias("passed"), (n - ok).alias("rejected"), F.when(n > 0, F.round(100 * ok / n, 1)).alias("percent"))


def crosscheck(rows: DataFrame, judge: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Deterministic reason and verdict together. Without a judge's answers (key, verdict, rule) the dry judge repeats
    the reason. ok: no reason and the verdict is pass."""
    if judge is None:
        out = rows.withColumns({"verdict": F.when(F.col("reject_reason").isNull(), "pass").otherwise("fail"), "rule": F.when(F.col("reject_reason").isNotNull(), F.lit("deterministic"))})
    else:
        out = rows.join(judge.select(key, "verdict", "rule"), key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("error")))
    return out.withColumn("ok", F.col("reject_reason").isNull() & (F.col("verdict") == "pass"))


def top_reasons(checked: DataFrame, n: int = 15) -> DataFrame:
    """The most frequent reasons among failures, by kind, cut to 40 characters."""
    failed = checked.where("not ok")
    det = F.when(F.col("reject_reason").isNotNull(), F.concat(F.lit("det:"), F.substring("reject_reason", 1, 40)))
    judged = F.when(F.col("verdict") != "pass", F.concat(F.lit("judge:"), F.substring(F.coalesce("rule", "verdict"), 1, 40)))
    return failed.select(F.explode(F.array_compact(F.array(det, judged))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)
