"""Rendering of histories, contexts and prompts; lenient JSON; the labeler protocol and its dry stand-in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "stage": "Stage", "next_key": "Next question key", "answers": "Answers collected", "reason": "Ineligibility reason",
    "agent": "Agent name", "client": "Client name", "latest": "Client's latest message", "is_first": "Is first message",
}
NO_TOKENS = "Write real names, never bracketed placeholders."
NO_NODS = "These are text messages: at most one of the three may open with an acknowledgement."
_SHAPE = '"recommendations": three of {"suggested_message": text, "confidence": one of high, medium, low}'
ASK = "Return only JSON: {" + _SHAPE + "}"
ASK_CONTEXT = 'Return only JSON: {"context": {the eight fields}, ' + _SHAPE + "}"

RECS = "array<struct<suggested_message:string,confidence:string>>"


def history(turns: Column) -> Column:
    """One line a turn: CLIENT or REP, and the text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.when(t["role"] == "client", "CLIENT: ").otherwise("REP: "), t["text"])), "\n")


def context_block(*, title: str = "CURRENT CONTEXT", **columns: Column) -> Column:
    """The eight fields, a line each; missing ones are N/A."""
    lines = [F.concat(F.lit(label + ": "), F.coalesce(columns.get(name, F.col(name)), F.lit("N/A"))) for name, label in FIELDS.items()]
    return F.concat_ws("\n", F.lit(f"--- {title} ---"), *lines, F.lit("---"))


def prompt_scenario() -> Column:
    return F.concat_ws("\n", context_block(), F.lit(""), F.lit("TASK: write exactly 3 suggested messages for this context."), F.lit(NO_TOKENS), F.lit(NO_NODS), F.lit(ASK))


def prompt_situation(anchor: Column | None = None) -> Column:
    """Context, directive, and an experienced reply as an anchor where there is one."""
    parts = [context_block(), F.lit(""), F.col("directive")]
    if anchor is not None:
        parts.append(F.when(anchor.isNotNull() & (anchor != ""), F.concat(F.lit('\nOne suggestion should say, as a text message: "'), anchor, F.lit('".'))))
    return F.concat_ws("\n", *parts, F.lit("\nWrite exactly 3 suggested messages that follow the situation."), F.lit(NO_TOKENS), F.lit(NO_NODS), F.lit(ASK))


def prompt_conversation() -> Column:
    """History and the reply that was sent; the model infers the context."""
    return F.concat(
        F.lit("Agent name: "), F.coalesce("agent_name", F.lit("Alex")), F.lit("\nClient name: "), F.coalesce("client_name", F.lit("there")), F.lit("\n\n--- CONVERSATION SO FAR ---\n"), history(F.col("history")),
        F.lit("\n\n--- SENT NEXT ---\n"), F.col("gold_reply"), F.lit("\n\nTASK: infer the context of the next turn, then write exactly 3 suggestions, one of them a cleaned version of what was sent.\n"), F.lit("\n".join([NO_TOKENS, NO_NODS, ASK_CONTEXT])),
    )


def prompt_judge() -> Column:
    """Context, situation and the numbered suggestions for a strict reviewer."""
    listed = F.transform("recommendations", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". ("), F.coalesce(r["confidence"], F.lit("?")), F.lit(") "), F.coalesce(r["suggested_message"], F.lit(""))))
    return F.concat_ws(
        "\n", context_block(title="CONTEXT"), F.when(F.coalesce("directive", F.lit("")) != "", F.concat(F.lit("\n"), F.col("directive"))), F.lit("\n--- SUGGESTIONS ---"), F.array_join(listed, "\n"),
        F.lit('\nTASK: do the suggestions follow every rule of voice, stage and safety? Return only JSON: {"verdict": pass or fail, "violations": list of {"rule", "which", "detail"}, "summary": one sentence}'),
    )


def verdicts(answers: DataFrame, key: str = "id") -> DataFrame:
    """key, verdict, rule (of the first violation) from a judge's raw answers; verdict error where there is none."""
    parsed = F.from_json(json_object(F.col("raw")), "verdict string, violations array<struct<which:string,rule:string,detail:string>>, summary string")
    return answers.select(key, F.coalesce(parsed["verdict"], F.lit("error")).alias("verdict"), F.get(parsed["violations"], F.lit(0))["rule"].alias("rule"))


def within_budget(tasks: DataFrame, prompt: Column, longest: int, answer: int = 700, slack: int = 256, count: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """Tasks whose prompt fits. ``count`` gives the tokens of a batch of texts; without it a token is four characters."""
    room = longest - answer - slack
    if count is None:
        return tasks.where(F.ceil(F.length(prompt) / 4) <= room)
    counted = F.pandas_udf(lambda s: pd.Series(count(s.fillna("").tolist())), "long")
    return tasks.where(counted(prompt) <= room)


def json_object(c: Column) -> Column:
    """The first '{' to the last '}' of a text without code fences; null without any."""
    bare = F.regexp_replace(c, r"(?m)^`{3}(?:json)?|`{3}$", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def recommendations(c: Column) -> Column:
    """The recommendations of a JSON text, null unless it is an object with a list of them. A message or confidence that isn't a
    string is null, as is all of an element that isn't an object."""
    return F.transform(_listed(_object(c)), lambda r: F.struct(*[_string(r, k).alias(k) for k in ("suggested_message", "confidence")]))


def _object(c: Column) -> Column:
    """A JSON text as a variant, null unless it is one object and nothing else."""
    return F.when(c.rlike(r"\A\s*\{") & c.rlike(r"(?s)\}\s*\z"), F.try_parse_json(c))


def _listed(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$.recommendations", "array<variant>")


def _string(v: Column, key: str) -> Column:
    value = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def _recs(*pairs: tuple[Column, str]) -> Column:
    return F.array(*[F.struct(m.alias("suggested_message"), F.lit(c).alias("confidence")) for m, c in pairs])


def dry_label(tasks: DataFrame) -> DataFrame:
    """Deterministic labels without a model, by kind: situations answer with the anchor, scenarios with the latest message,
    conversations with the reply that was sent (cut to 160 characters). Columns a kind lacks may be missing."""
    for c, t in (("anchor", "string"), ("gold_reply", "string"), ("latest", "string"), ("history", "array<struct<role:string,text:string>>"), ("kind", "string")):
        if c not in tasks.columns:
            tasks = tasks.withColumn(c, F.lit(None).cast(t))
    kind = F.coalesce("kind", F.lit("convo"))
    cut = lambda c: F.substring(c, 1, 160)
    anchor = F.coalesce(F.when(F.col("anchor") != "", F.col("anchor")), F.lit("whenever suits you, I am here"))
    base = F.when(kind == "scenario", F.col("latest")).otherwise(F.col("gold_reply"))
    other = _recs((cut(base), "medium"), (F.lit("which number is best to reach you?"), "low"), (F.lit("glad to go on whenever you like"), "low"))
    situation = _recs((cut(anchor), "medium"), (F.lit("there is no hurry from my side"), "low"), (F.lit("tell me how you would like to proceed"), "low"))
    said = F.substring(F.get("history", F.size("history") - 1)["text"], 1, 60)
    return tasks.withColumns({"kind": kind, "recommendations": F.when(kind == "situation", situation).otherwise(other), "latest": F.when(kind == "convo", said).otherwise(F.col("latest"))})


def labelled(tasks: DataFrame, prompt: Column, call: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """The tasks with ``raw``, ``error`` and ``recommendations`` from an injected model: ``call`` answers a batch of prompts, null for a failure.
    If a batch fails, its prompts are asked one by one, so that only those that fail have an error."""

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return call([prompt])[0], None
        except Exception as e:  # a failed call is data, not a failed job
            return None, f"{type(e).__name__}: {e}"

    def ask(prompts: pd.Series) -> pd.DataFrame:
        asked = prompts.tolist()
        try:
            rows = [(raw, None) for raw in call(asked)]
            if len(rows) != len(asked):
                raise ValueError("not an answer for every prompt")
        except Exception:
            rows = [one(p) for p in asked]
        return pd.DataFrame(rows, columns=["raw", "error"], dtype=object)

    answered = tasks.withColumn("_answer", F.pandas_udf(ask, "raw string, error string").asNondeterministic()(prompt))
    out = answered.withColumns({"raw": F.col("_answer.raw"), "error": F.col("_answer.error")}).drop("_answer")
    return out.withColumn("recommendations", recommendations(json_object(F.col("raw"))))


def assembled(answers: DataFrame) -> DataFrame:
    """Labelled records from answered tasks: the eight context fields, recommendations, directive and mode (of situations only) and meta
    (source, file, kind, case). Situations and scenarios keep their task's context; that of conversations is the answer's, except that
    the names of agent and client are the task's. Columns that tasks lack may be missing; what nothing gives is null."""
    text = lambda c, otherwise=None: F.coalesce(F.col(f"`{c}`").cast("string") if c in answers.columns else F.lit(None).cast("string"), F.lit(otherwise).cast("string"))
    kind = text("kind", "convo")
    convo = ~kind.isin("scenario", "situation")
    context = F.from_json(json_object(F.col("raw")), "context map<string,string>")["context"]
    given = {name: F.try_element_at(context, F.lit(label)) for name, label in FIELDS.items()}
    given |= {"agent": text("agent_name", "Alex"), "client": text("client_name", "there")}
    fields = {name: F.when(convo, given[name]).otherwise(text(name)) for name in FIELDS}
    rest = {c: F.when(kind == "situation", text(c)) for c in ("directive", "mode")}
    meta = F.struct(text("source", "scenario").alias("source"), text("file").alias("file"), kind.alias("kind"), text("case").alias("case"))
    return answers.select(*[c.alias(k) for k, c in fields.items()], "recommendations", *[c.alias(k) for k, c in rest.items()], meta.alias("meta"))


def evaluation_rows(answers: DataFrame, idx: str = "id") -> DataFrame:
    """A flat row of 21 columns for each answered task, in the order of the model test's table; empty strings where something is missing.
    ok is 1 where the answer holds a JSON object. An answer without one, recommendations that are no list, and an
    element that is no object give an ``error``; the suggestions before such an element are kept."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in answers.columns else F.lit("")
    names = {"kind": "kind", "case": "case", "stage": "stage", "next_key": "next_key", "answers_collected": "answers", "ineligibility_reason": "reason", "client_latest": "latest", "is_first": "is_first", "agent": "agent", "client": "client"}
    parsed = _object(json_object(F.col("raw")))
    any_ = F.try_variant_get(parsed, "$.recommendations", "variant")
    listed = F.when(any_.isNull(), F.array().cast("array<variant>")).otherwise(_listed(parsed))
    is_object = lambda r: F.schema_of_variant(r).startswith("OBJECT")
    found = answers.withColumns({"_ok": parsed.isNotNull(), "_recs": F.when(parsed.isNotNull(), listed)})
    first_bad = F.coalesce(F.array_position(F.transform(F.slice("_recs", 1, 3), lambda r: F.coalesce(is_object(r), F.lit(False))), False), F.lit(0))
    found = found.withColumn("_bad", first_bad)
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("_ok"), F.lit("no JSON object in the answer")).when(F.col("_recs").isNull(), F.lit("recommendations is not a list")).when(F.col("_bad") > 0, F.lit("a recommendation is not an object"))
    flat = {"ok": F.col("_ok").cast("int"), "n_suggestions": F.greatest(F.coalesce(F.size("_recs"), F.lit(0)), F.lit(0))}
    for k in range(3):
        here = (F.col("_bad") == 0) | (F.col("_bad") > k + 1)
        value = lambda key, k=k, here=here: F.coalesce(F.when(here, F.try_variant_get(F.get("_recs", F.lit(k)), f"$.{key}", "string")), F.lit(""))
        flat |= {f"suggestion_{k + 1}": value("suggested_message"), f"confidence_{k + 1}": value("confidence")}
    return found.select(F.col(idx).alias("idx"), *[text(c).alias(k) for k, c in names.items()], *[c.alias(k) for k, c in flat.items()], F.coalesce("raw", F.lit("")).alias("raw_response"), F.coalesce(problem, F.lit("")).alias("error"))
