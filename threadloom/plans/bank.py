"""Synthetic rows that exercise every rule; the shipped tables hold invented prose without any of the cues.

A row attaches to a conversation turn by (7 conv_id + 3 turn) mod N, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COMPANY

#: latest, mode, stage, is_first, client, next_key, directive, (message, confidence) x 3
_A = ("Shall we look at the figures together this week?", "Which town are you hoping to move to?", "Tell me a bit about your plans for the place.")


def _row(latest: str = "we are looking at homes", mode: str = "", stage: str = "qualifying", first: str = "no", client: str = "Grace", key: str = "N/A", directive: str = "", s: tuple = _A, c: tuple = ("high", "medium", "low"), raw: str = "") -> tuple:
    return (latest, mode, stage, first, client, key, directive, *s, *c, raw)


def _with(text: str, at: int = 0) -> tuple:
    return tuple(text if k == at else x for k, x in enumerate(_A))


ROWS: list[tuple] = [
    _row(),
    _row(s=("", _A[1], _A[2])),
    _row(c=("high", "sure", "low")),
    _row(s=_with("word " * 85)),
    _row(s=_with("One. Two! Three? Four.", 1)),
    _row(s=_with("We have 6.5 % today for you", 2)),
    _row(s=_with("About $ 300 a month, Grace")),
    _row(s=_with("Thanks {NAME_GIVEN}, talk soon my friend")),
    _row(s=("Well, one thing here", "well! another thing here", "Well another one here")),
    _row(s=("Got it, so when would you move?", "Perfect, so where would you move?", _A[2])),
    _row(stage="ineligible", s=_with("The file was rejected for the moment")),
    _row(latest="Hey there", first="yes", s=_with(f"Hi Grace, {COMPANY} here, how are you?")),
    _row(latest="hello", first="yes", s=tuple(f"{x} I am with {COMPANY}" for x in ("Hi Grace!", "Good day!", "Nice to meet you."))),
    _row(latest="I just lost my wife", mode="empathy", s=_with("How do you plan to use the property?")),
    _row(latest="stop", mode="stop", directive="SITUATION: the client asked to stop.", s=("Understood, take care now", "All right, bye for now", "Do you mean it?")),
    _row(latest="i'm driving right now", mode="logistics", s=_with("You can send the application later on", 2)),
    _row(latest="my dad passed away and the house title is open", s=_with("Then the next step is the mortgage form")),
    _row(latest="he died last night"),
    _row(latest="are you a bot?", s=_with("No, I'm a real person over here")),
    _row(s=("Got it. Okay, so where is the house, Grace?", "Hey Grace, which street is the house on?", "Thanks for sharing - what is the plan, Grace")),
    _row(s=("Got it.", _A[1], _A[2])),
    _row(s=("Great, where do you live now", "okay... where do you live now", "Where do you live now")),
    _row(latest="what documents do i need?", mode="loan_question", key="property_use", directive="SITUATION: the client asked a mortgage question.", s=("It depends on the loan you take.", "A payslip and an id are the basics.", "We can look at a list together.")),
    _row(latest="just chatting", key="N/A", directive="SITUATION: small talk.", s=("Sunny over here as well today.", "I hope the game went fine.", "Enjoy the rest of the day.")),
    _row(raw="not json"),
    _row(raw='{"recommendations": [{"suggested_message": "just one here", "confidence": "high"}]}'),
    _row(raw='{"recommendations": "none"}'),
    _row(s=_with("One.\u00a0Two!\u2003Three?\u00a0Four.", 2)),
    _row(client="N/A", s=_with("Hey N/A, where are you now?")),
    _row(latest="going with another lender", mode="other_lender", s=_with("Fair enough  , a second look may help ?")),
]
NAMES = ["latest", "mode", "stage", "is_first", "client", "next_key", "directive", "s1", "s2", "s3", "c1", "c2", "c3", "raw"]

#: Client turns for intents, topics and redaction.
SAID = [
    "I just got fired from the mill", "my husband died in may", "STOP texting", "unsubscribe please", "my attorney will call you", "this is harassment, really", "not interested, sorry", "I changed my mind about it",
    "my bank is handling it", "we are going with someone else", "I'm at work until five", "can't talk now", "what's your rate these days", "give me the best rate", "how much can i borrow for a house?", "do i need a lawyer? what are the steps?",
    "we want to refinance the home", "the interest rate matters most", "ok", "see www or https://a.example/x?y=1 for it", "mail me at ann.b+c@mail.example.org today", "call +1 (555) 123-4567 or 555 010 9999", "we paid $ 412,500.50 for it", "it is 12 N. Oakwood near the park", "stopped by the bank earlier",
]
#: Texts of SMS threads and lines of transcripts with noise.
SMS = ["  Reply STOP to end", "Msg & data rates may apply", "- Anna", "Thanks, - bob", "this is an automated note", "well   this\tis fine", "- two words stay", "unsubscribed people stay too", "so\rlong", "fine", "- José", "thanks, — Zoë", "– René", "- José left"]
LINES = ["yeah", "Okay.", "Thank you for calling us", "press 1 now", "mm hmm", "we  want   a house", "this call may be monitored", "OK", "right", "sure thing then"]
SPEAKERS = ["Agent", "Customer", "Internal", "External", "Agent 1", "CLIENT", "Robot"]
#: Raw answers of a model: types, lengths, fences, elements that are no objects.
_SAY = '{"suggested_message": "%s", "confidence": "%s"}'
_THREE = [_SAY % (m, c) for m, c in (("Which street is it on?", "high"), ("When would you move?", "low"), ("Shall we talk on Sunday?", "medium"))]
RAWS = [
    '{"recommendations": [%s]}' % ", ".join(_THREE), "```json\n{\"recommendations\": [%s]}\n```" % ", ".join(_THREE), '{"recommendations": [{"suggested_message": 5, "confidence": "high"}, %s]}' % ", ".join(_THREE[1:]),
    '{"recommendations": [%s, {"suggested_message": true, "confidence": "low"}]}' % ", ".join(_THREE[:2]), '{"recommendations": [%s, 7]}' % ", ".join(_THREE[:2]), '{"recommendations": [%s]}' % _THREE[0],
    '{"recommendations": "none"}', "{}", "no object", '{"recommendations": [{"suggested_message": "When?", "confidence": 3}, %s]}' % ", ".join(_THREE[1:]), '{"recommendations": [{"confidence": "low"}, %s]}' % ", ".join(_THREE[1:]),
]
#: Texts with one name at most, and names that redaction knows.
NAMED = ["Hey Anna, are you there", "thank you Tom Reed for that", "hello there", "this is Vera Lind calling", "I'm Otto Karl Braun", "see you then - Bob", "all fine — Eva Holm ", "we saw James today", "the grace period is over", "Grace called", "JAMES called", "dear  Zoe"]
KNOWN = ["james", "grace"]
RESIDUE = ["no token", "hi {NAME} here", "{not a token}", "{NAME_1} slips by", "{MONEY}", "{A}"]


def quote(v: object) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows: list[tuple], names: list[str], alias: str = "bank") -> str:
    """A DuckDB table expression; the row number is ``i``."""
    body = ", ".join(f"({k}, {', '.join(map(quote, r))})" for k, r in enumerate(rows))
    return f"(VALUES {body}) AS {alias}(i, {', '.join(names)})"


def frame(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))


def attach(turns: DataFrame, bank: DataFrame, n: int) -> DataFrame:
    """Turns with their row of the bank (a literal table of fixed size, hence broadcast)."""
    return turns.withColumn("i", ((7 * F.col("conv_id") + 3 * F.col("turn")) % n).cast("int")).join(F.broadcast(bank), "i").drop("i")
