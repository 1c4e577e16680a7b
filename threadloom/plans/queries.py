"""One query for every operator, each over the driver's tables, and the same in DuckDB SQL.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` maps it to SQL where SQL can express it.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COMPANY
from ..functions.text import hash_pick_sql, strip
from ..operators import audit, cleaner, conversation, metrics, prompts, scenarios, sft, surrogates, tasks
from ..session import shared_folder
from ..sources import files
from . import bank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return bank.quote(pattern)


# ---- turns --------------------------------------------------------------------------------

#: A signature as RE2 has it, letters of all scripts included.
SIGNATURE = q(r"(?i)^\s*(thanks[,!]*\s*)?[-–—]\s*[\p{L}\p{N}_]+\s*$")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role (agent, client), text of the conversations table."""
    role = F.when(F.col("role") == "user", "client").when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    return conversation.clean_sms(table(spark, sf_dir, "conversations").withColumn("role", role))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of 60 characters or more, merged: short ones play the part of nods."""
    return conversation.merge_turns(turns(spark, sf_dir).where(F.length("text") >= 60))


TURNS = rf"""turns AS (SELECT conv_id, turn, role, text FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'client' WHEN 'assistant' THEN 'agent' END AS role,
  regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13), ' '), '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g') AS text FROM conversations)
  WHERE role IS NOT NULL AND text <> '' AND NOT regexp_matches(text, {q(conversation.SMS_NOISE)}) AND NOT regexp_matches(text, {SIGNATURE}))"""
MERGED = f"""{TURNS}, marked AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM turns WHERE length(text) >= 60),
islands AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT conv_id, (island - 1)::INTEGER AS turn, min(role) AS role, string_agg(text, ' ' ORDER BY turn) AS text, count(*)::INTEGER AS parts FROM islands GROUP BY conv_id, island)"""


@query(f"WITH {TURNS} SELECT * FROM turns")
def role_normalize(spark, sf_dir):
    return turns(spark, sf_dir)


@query(f"WITH {MERGED} SELECT * FROM merged")
def turn_merge(spark, sf_dir):
    return merged(spark, sf_dir)


@query(f"WITH {MERGED}, n AS (SELECT conv_id, count(*) AS n FROM merged GROUP BY 1) SELECT (SELECT count(*) FROM n WHERE n >= 4) AS kept, (SELECT count(DISTINCT conv_id) FROM conversations) - (SELECT count(*) FROM n WHERE n >= 4) AS skipped")
def min_turn_filter(spark, sf_dir):
    m = merged(spark, sf_dir)
    return conversation.kept_skipped(table(spark, sf_dir, "conversations"), conversation.at_least(m, 4))


_SMS = bank.values([(t,) for t in bank.SMS], ["noise"])


@query(
    rf"""WITH x AS (SELECT conv_id, turn, regexp_replace(regexp_replace(replace(noise, chr(13), ' '), '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g') AS text
FROM conversations JOIN {_SMS} ON i = (7 * conv_id + 3 * turn) % {len(bank.SMS)})
SELECT text, count(*) AS n FROM x WHERE text <> '' AND NOT regexp_matches(text, {q(conversation.SMS_NOISE)}) AND NOT regexp_matches(text, {SIGNATURE}) GROUP BY text"""
)
def boilerplate_drop(spark, sf_dir):
    noisy = bank.attach(table(spark, sf_dir, "conversations"), bank.frame(spark, [(t,) for t in bank.SMS], ["noise"]), len(bank.SMS))
    return conversation.clean_sms(noisy.select("conv_id", "turn", F.lit("agent").alias("role"), F.col("noise").alias("text"))).groupBy("text").agg(F.count("*").alias("n"))


def call_lines(spark, sf_dir) -> DataFrame:
    joined = bank.attach(table(spark, sf_dir, "conversations"), bank.frame(spark, [(t,) for t in bank.LINES], ["said"]), len(bank.LINES))
    speaker = F.get(F.array(*map(F.lit, bank.SPEAKERS)), ((F.col("conv_id") + F.col("turn")) % len(bank.SPEAKERS)).cast("int"))
    text = F.when(F.col("turn") % 3 == 0, F.col("said")).otherwise(F.col("text"))
    return joined.select("conv_id", "turn", F.concat(F.lit("[00:01:0"), (F.col("turn") % 10).cast("string"), F.lit("] "), speaker, F.lit(": "), F.regexp_replace(text, "\n", " ")).alias("line"))


@query(
    rf"""WITH l AS (SELECT conv_id, turn, '[00:01:0' || (turn % 10) || '] ' || ([{", ".join(map(q, bank.SPEAKERS))}])[(conv_id + turn) % {len(bank.SPEAKERS)} + 1] || ': ' || replace(CASE WHEN turn % 3 = 0 THEN said ELSE text END, chr(10), ' ') AS line
FROM conversations JOIN {bank.values([(t,) for t in bank.LINES], ["said"])} ON i = (7 * conv_id + 3 * turn) % {len(bank.LINES)}),
p AS (SELECT conv_id, turn, lower(trim(regexp_extract(line, {q(conversation.CALL_LINE)}, 1))) AS who, trim(regexp_replace(regexp_extract(line, {q(conversation.CALL_LINE)}, 2), '\s+', ' ', 'g')) AS text FROM l)
SELECT conv_id, turn, CASE WHEN who IN ('agent', 'internal') THEN 'agent' ELSE 'client' END AS role, text FROM p
WHERE who IN ('agent', 'internal', 'client', 'customer', 'external') AND text <> '' AND NOT regexp_matches(text, {q(conversation.CALL_NOISE)}) AND lower(text) NOT IN ({", ".join(map(q, conversation.NODS))})"""
)
def transcript_parse(spark, sf_dir):
    return conversation.parse_call_lines(call_lines(spark, sf_dir))


@query("SELECT conv_id, turn AS ordinal, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 = 0 THEN '' ELSE md5(text) END, turn) - 1)::INTEGER AS turn FROM conversations")
def message_sort(spark, sf_dir):
    stamped = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.when(F.col("turn") % 3 != 0, F.md5("text")).alias("timestamp"))
    return conversation.by_timestamp(stamped).select("conv_id", "ordinal", "turn")


# ---- tasks --------------------------------------------------------------------------------

CANDIDATES = f"""{MERGED}, asked AS (SELECT *, max(CASE WHEN role = 'client' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM merged),
candidates AS (SELECT conv_id, turn AS turn_idx, turn = 1 AS is_first, text AS gold_reply FROM asked WHERE role = 'agent' AND asked = 1)"""


@query(f"WITH {CANDIDATES} SELECT * FROM candidates")
def task_candidates(spark, sf_dir):
    return tasks.candidates(merged(spark, sf_dir))


@query(
    f"""WITH {CANDIDATES} SELECT conv_id, turn_idx, is_first, gold_reply, pick FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY head DESC, md5('7|' || conv_id || '|' || turn_idx), turn_idx)::INTEGER AS pick
FROM (SELECT *, turn_idx = min(turn_idx) OVER (PARTITION BY conv_id) AS head FROM candidates)) WHERE pick <= 2"""
)
def task_head_sample_cap(spark, sf_dir):
    return tasks.head_and_sample(tasks.candidates(merged(spark, sf_dir)), 2, 7)


@query(
    f"""WITH {CANDIDATES}, lines AS (SELECT conv_id, turn, CASE role WHEN 'client' THEN 'CLIENT: ' ELSE 'REP: ' END || text AS line FROM merged),
h AS (SELECT c.conv_id, turn_idx, list(line ORDER BY turn) AS ls FROM candidates c JOIN lines l ON c.conv_id = l.conv_id AND turn < turn_idx GROUP BY ALL)
SELECT conv_id, turn_idx, array_to_string(CASE WHEN len(ls) > 3 THEN ls[len(ls) - 2:] ELSE ls END, chr(10)) AS history FROM h"""
)
def history_render(spark, sf_dir):
    out = tasks.candidates(merged(spark, sf_dir), last=3)
    return out.select("conv_id", "turn_idx", prompts.history(F.col("history")).alias("history"))


SAID = bank.values([(t,) for t in bank.SAID], ["said"])
SAID_TURNS = f"said AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'client' ELSE 'agent' END AS role, said AS text FROM conversations JOIN {SAID} ON i = (7 * conv_id + 3 * turn) % {len(bank.SAID)})"
INTENT = "CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}) THEN {q(n)}" for n, p in tasks.INTENTS) + " END"


def said(spark, sf_dir) -> DataFrame:
    joined = bank.attach(table(spark, sf_dir, "conversations"), bank.frame(spark, [(t,) for t in bank.SAID], ["said"]), len(bank.SAID))
    return joined.select("conv_id", "turn", F.when(F.col("role") == "user", "client").otherwise("agent").alias("role"), F.col("said").alias("text"))


@query(f"WITH {SAID_TURNS} SELECT text, {INTENT} AS intent, count(*) AS n FROM said WHERE role = 'client' GROUP BY ALL")
def intent_classify(spark, sf_dir):
    return said(spark, sf_dir).where("role = 'client'").groupBy("text", tasks.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


@query(f"WITH {SAID_TURNS}, g AS (SELECT conv_id FROM said GROUP BY 1 HAVING regexp_matches(string_agg(text, ' ' ORDER BY turn), {q(tasks.TOPIC)})) SELECT conv_id, count(*) AS turns FROM said SEMI JOIN g USING (conv_id) GROUP BY 1")
def topic_filter(spark, sf_dir):
    return tasks.on_topic(said(spark, sf_dir)).groupBy("conv_id").agg(F.count("*").alias("turns"))


@query(
    f"""WITH {SAID_TURNS}, c AS (SELECT {INTENT} AS "case", text AS message, conv_id, turn FROM said WHERE role = 'client' AND length(text) >= 8),
u AS (SELECT * FROM c WHERE "case" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case", lower(message) ORDER BY md5('0|' || conv_id || '|' || turn), conv_id, turn) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY md5('0|' || lower(message)), lower(message))::INTEGER AS rank FROM u)
SELECT "case", CASE "case" {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tasks.MODE_OF.items())} ELSE "case" END AS mode, message, rank FROM r WHERE rank <= 1"""
)
def intent_dedup_cap(spark, sf_dir):
    return tasks.mined(said(spark, sf_dir), per=1)


_W, _S, _D = r"\p{L}\p{M}\p{N}\p{Pc}", r"\s\x{85}\p{Z}", r"\p{Nd}"
REDACT = "text"
for _p, _r in (
    (rf"https?://[^{_S}]+", ""), (rf"[{_W}.+-]+@[{_W}-]+\.[{_W}.]+", "someone@example.com"), (rf"\+?{_D}[{_D}{_S}()-]{{7,}}{_D}", "(555) 010-4321"), (rf"[$][{_S}]?[{_D},]+(\.{_D}+)?", "$300k"),
    (rf"\b{_D}{{1,6}}[{_S}]+[NSEW]\.?[{_S}]+[A-Z][a-z]+", "a property nearby"),
):
    REDACT = f"regexp_replace({REDACT}, {q(_p)}, {q(_r)}, 'g')"


@query(f"WITH {SAID_TURNS} SELECT doc_id, md5({REDACT}) AS digest FROM documents UNION ALL SELECT conv_id, {REDACT} FROM said")
def redact_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(surrogates.redact_contacts(F.col("text"))).alias("digest"))
    return docs.unionAll(said(spark, sf_dir).select("conv_id", surrogates.redact_contacts(F.col("text"))))


_ONE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
_NAMING = [(rf"\b((?i:hi|hey|hello|thanks|thank you|dear))\s+({_ONE})", " "), (rf"\b((?i:my name is|this is|name is|it'?s|i'?m))\s+({_ONE}(?:\s+[A-Z][a-z]+)?)", " "), (rf"()[-–—]\s*({_ONE})\s*$", "- "), (r"\b()(James|Grace)\b", "")]
_NAME = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN regexp_extract(t, {q(p)}, 2)" for p, _ in _NAMING) + " END"
_RENAMED = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN regexp_replace(t, {q(p)}, {q(chr(92) + '1' + between)} || sur)" for p, between in _NAMING) + " ELSE t END"


@query(rf"""WITH x AS (SELECT conv_id, turn, t, {_NAME} AS name FROM conversations JOIN {bank.values([(t,) for t in bank.NAMED], ['t'])} ON i = (7 * conv_id + 3 * turn) % {len(bank.NAMED)}),
y AS (SELECT *, {hash_pick_sql(surrogates.MINED, "lower(trim(name))")} AS sur FROM x) SELECT conv_id, turn, trim(regexp_replace({_RENAMED}, '\s{{2,}}', ' ', 'g')) AS redacted FROM y""")
def redact_names(spark, sf_dir):
    """Names after greetings and introductions, in signatures, and known ones, in texts that hold one name at most."""
    rows = bank.attach(table(spark, sf_dir, "conversations").select("conv_id", "turn"), bank.frame(spark, [(t,) for t in bank.NAMED], ["t"]), len(bank.NAMED))
    return rows.select("conv_id", "turn", surrogates.redact(F.col("t"), bank.KNOWN).alias("redacted"))


@query(
    rf"""WITH f AS (SELECT DISTINCT 'conv-' || conv_id AS file FROM conversations),
p AS (SELECT file, list(n ORDER BY md5(file || '|' || n), n) AS pool FROM f, (SELECT unnest([{", ".join(map(q, surrogates.NAMES))}]) AS n) GROUP BY file)
SELECT file, ('0x' || md5(file)[1:8])::BIGINT AS seed, pool[1] AS agent_name, pool[2] AS client_name FROM p"""
)
def surrogate_names(spark, sf_dir):
    files = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), "conv_id").alias("file")).distinct()
    pool = surrogates.pool(F.col("file"))
    return files.select("file", surrogates.seed(F.col("file")).alias("seed"), F.get(pool, F.lit(0)).alias("agent_name"), F.get(pool, F.lit(1)).alias("client_name"))


TOKENS = ["hi {NAME}, how are you", "this is {NAME_GIVEN} with us", "{NAME} met {NAME_SURNAME}  and {NAME}", "call {PHONE_NUMBER} about {MONEY}", "{ORG} in {CITY}, {STATE} on {DATE}", "write to {EMAIL}{UNKNOWN}", "plain"]


NAMED = rf"""x AS (SELECT 'conv-' || conv_id AS file, conv_id, turn, tok FROM conversations JOIN {bank.values([(t,) for t in TOKENS], ["tok"])} ON i = (7 * conv_id + 3 * turn) % {len(TOKENS)}),
p AS (SELECT file, list(n ORDER BY md5(file || '|' || n), n) AS pool FROM (SELECT DISTINCT file FROM x), (SELECT unnest([{", ".join(map(q, surrogates.NAMES))}]) AS n) GROUP BY file),
m AS (SELECT x.*, pool, regexp_replace(regexp_replace(tok, '(?i)(this is\s+)\{{NAME(?:_GIVEN)?\}}(\s+with)', '\1' || pool[1] || '\2'), '(?i)^(\s*(?:hello|hey|hi)[,!\s]+)\{{NAME(?:_GIVEN)?\}}', '\1' || pool[2]) AS met FROM x JOIN p USING (file)),
c AS (SELECT *, len(regexp_extract_all(met, {q(surrogates.NAME_TOKEN)})) AS names, len(regexp_extract_all(met, '\{{[A-Z_]*EMAIL[A-Z_]*\}}')) AS mails FROM m),
d AS (SELECT *, 2 + coalesce(sum(names + mails) OVER (PARTITION BY file ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS drawn, string_split_regex(met, {q(surrogates.NAME_TOKEN)}) AS parts FROM c),
f AS (SELECT *, array_to_string(list_transform(parts, lambda v, k: v || CASE WHEN k < len(parts) THEN pool[((drawn + k - 1) % {len(surrogates.NAMES)})::INTEGER + 1] ELSE '' END), '') AS named FROM d)"""


@query(rf"WITH {NAMED} SELECT file, turn, pool[1] AS agent_name, pool[2] AS client_name, trim(regexp_replace(named, '\s{{2,}}', ' ', 'g')) AS text FROM f WHERE NOT regexp_matches(named, '\{{')")
def rehydrate_names(spark, sf_dir):
    """Introductions, greetings and names with the running draw of turns without other tokens."""
    rows = bank.attach(table(spark, sf_dir, "conversations"), bank.frame(spark, [(t,) for t in TOKENS], ["tok"]), len(TOKENS))
    out = surrogates.rehydrate(rows.select(F.concat(F.lit("conv-"), "conv_id").alias("file"), "turn", "tok", F.col("tok").alias("text")))
    return out.where(~F.regexp_replace("tok", surrogates.NAME_TOKEN, "").contains("{")).select("file", "turn", "agent_name", "client_name", "text")


# The other tokens, each at its ordinal in the rows of TOKENS.
_KEY = lambda k, token: f"file || '|' || turn || '|{k}|{{{token}}}'"
_PHONE = f"('0x' || md5({_KEY(0, 'PHONE_NUMBER')})[1:12])::BIGINT"
_FILLED = f"replace(replace(named, '{{PHONE_NUMBER}}', '(' || (200 + {_PHONE} % 790) || ') ' || (200 + {_PHONE} // 1000 % 790) || '-' || (1000 + {_PHONE} // 1000000 % 9000)), '{{MONEY}}', {hash_pick_sql(surrogates.MONEY, _KEY(0, 'MONEY'))})"
for _k, _token, _values in ((0, "ORG", surrogates.ORGANISATIONS), (1, "CITY", surrogates.CITIES), (2, "STATE", surrogates.STATES)):
    _FILLED = f"replace({_FILLED}, '{{{_token}}}', {hash_pick_sql(_values, _KEY(_k, _token))})"
_FILLED = f"replace(replace(replace({_FILLED}, '{{DATE}}', 'next Tuesday'), '{{UNKNOWN}}', ''), '{{EMAIL}}', lower(pool[((drawn + names) % {len(surrogates.NAMES)})::INTEGER + 1]) || '@example.com')"


@query(rf"WITH {NAMED} SELECT file, turn, pool[1] AS agent_name, pool[2] AS client_name, trim(regexp_replace({_FILLED}, '\s{{2,}}', ' ', 'g')) AS text FROM f")
def rehydrate_all(spark, sf_dir):
    """All tokens: names, phones, amounts, places, addresses."""
    rows = bank.attach(table(spark, sf_dir, "conversations"), bank.frame(spark, [(t,) for t in TOKENS], ["tok"]), len(TOKENS))
    return surrogates.rehydrate(rows.select(F.concat(F.lit("conv-"), "conv_id").alias("file"), "turn", F.col("tok").alias("text")))


@query(f"SELECT count(*) AS texts, count(*) FILTER (regexp_matches(t, {q(surrogates.ANY_TOKEN)})) AS leaking FROM conversations JOIN {bank.values([(t,) for t in bank.RESIDUE], ['t'])} ON i = (7 * conv_id + 3 * turn) % {len(bank.RESIDUE)}")
def leak_check(spark, sf_dir):
    return surrogates.leaks(bank.attach(table(spark, sf_dir, "conversations").drop("text"), bank.frame(spark, [(t,) for t in bank.RESIDUE], ["text"]), len(bank.RESIDUE)))


# ---- scenarios ----------------------------------------------------------------------------

# The state space written out in SQL: what is said (by topic), what has been answered (by case and step).
_SAID = {"open_owner": scenarios.OWNER_OPENERS, "open_first": scenarios.FIRST_OPENERS, "confirm": scenarios.CONFIRM, "affirm": scenarios.AFFIRM, "hello": scenarios.HELLO, "casual": scenarios.CASUAL, "busy": scenarios.BUSY, "off": scenarios.OFF}
_SAID |= {f"fine_{k}": v for k, v in scenarios.FINE.items()} | {f"fatal_{k}": v for k, v in scenarios.FATAL.items()}
_NA, _B, _F, _L = "foreclosure_past_2yr=n/a, late_payments_past_12mo=n/a", "bankruptcy_past_3yr", "foreclosure_past_2yr", "late_payments_past_12mo"
_STATES = [
    ("qualifying", "qualifying", "property_use", "open_owner", "N/A", "N/A", "no", ""), ("qualifying_first_time", "qualifying", "property_use", "open_first", _NA, "N/A", "no", ""),
    ("qualifying", "qualifying", _B, "fine_property_use", "property_use=?", "N/A", "no", "owner"), ("qualifying", "qualifying", _F, f"fine_{_B}", f"property_use=?, {_B}=no", "N/A", "no", "owner"),
    ("qualifying", "qualifying", _L, f"fine_{_F}", f"property_use=?, {_B}=no, {_F}=no", "N/A", "no", "owner"), ("qualifying_first_time", "qualifying", _B, "fine_property_use", f"property_use=?, {_NA}", "N/A", "no", "first"),
    ("ineligible", "ineligible", "N/A", f"fatal_{_B}", f"property_use=?, {_B}=yes, {_F}=no, {_L}=no", "bankruptcy_within_3yr", "no", "owner"), ("ineligible", "ineligible", "N/A", f"fatal_{_F}", f"property_use=?, {_B}=no, {_F}=yes, {_L}=no", "foreclosure_within_2yr", "no", "owner"),
    ("ineligible", "ineligible", "N/A", f"fatal_{_L}", f"property_use=?, {_B}=no, {_F}=no, {_L}=yes", "late_mortgage_within_12mo", "no", "owner"), ("ineligible_first_time", "ineligible", "N/A", f"fatal_{_B}", f"property_use=?, {_B}=yes, {_NA}", "bankruptcy_within_3yr", "no", "first"),
    ("greeting", "qualifying", "property_use", "hello", "N/A", "N/A", "yes", ""), ("casual", "qualifying", "N/A", "casual", "N/A", "N/A", "no", ""), ("logistics", "qualifying", "N/A", "busy", "N/A", "N/A", "no", ""), ("offtopic", "qualifying", "N/A", "off", "N/A", "N/A", "no", ""),
]
for _stage, _topic in (("confirming", "confirm"), ("eligible", "affirm")):
    _STATES += [(_stage, _stage, "N/A", _topic, f"property_use=?, {_B}=no, {_F}=no, {_L}=no", "N/A", "no", "owner"), (f"{_stage}_first_time", _stage, "N/A", _topic, f"property_use=?, {_B}=no, {_NA}", "N/A", "no", "first")]
_USES = [("owner", u) for u in scenarios.OWNER_USES] + [("first", u) for u in scenarios.FIRST_USES] + [("", "")]
SCENARIOS = f"""scenarios AS (SELECT "case", stage, next_key, replace(answers, '?', use) AS answers, reason, said AS latest, is_first,
([{", ".join(map(q, scenarios.AGENTS))}])[v % 8 + 1] AS agent, ([{", ".join(map(q, scenarios.CLIENTS))}])[(3 * v + 1) % 8 + 1] AS client, 'scenario' AS kind
FROM {bank.values(_STATES, ['"case"', "stage", "next_key", "topic", "answers", "reason", "is_first", "who"], "states")}
JOIN {bank.values([(k, t) for k, ts in _SAID.items() for t in ts], ["topic", "said"], "sayings")} USING (topic) JOIN {bank.values(_USES, ["who", "use"], "uses")} USING (who), range(8) AS r(v))"""


@query(f"WITH {SCENARIOS} SELECT * FROM scenarios")
def scenario_enumeration(spark, sf_dir):
    return scenarios.enumerate_scenarios(spark)


@query(f'WITH {SCENARIOS} SELECT "case", count(*) AS n FROM scenarios GROUP BY 1')
def scenario_case_hist(spark, sf_dir):
    return metrics.histogram(scenarios.enumerate_scenarios(spark), "case")


@query(f"WITH {SCENARIOS} SELECT answers, count(*) AS n FROM scenarios GROUP BY 1")
def answers_summary(spark, sf_dir):
    return scenarios.enumerate_scenarios(spark).groupBy("answers").agg(F.count("*").alias("n"))


_U = "(('0x' || md5('0|{}|' || id)[1:8])::BIGINT / 4294967296.0::DOUBLE)"
_EDGES = " ".join(f"WHEN u < {sum(w for _, w in scenarios._CASES[: k + 1])}::DOUBLE / 100 THEN {q(n)}" for k, (n, _) in enumerate(scenarios._CASES[:-1]))


@query(
    f"""SELECT "case", first, count(*) AS n FROM (SELECT CASE {_EDGES} ELSE 'offtopic' END AS "case", {_U.format("first")} < 0.3 AS first FROM (SELECT id, {_U.format("case")} AS u FROM range(4000) AS r(id))) GROUP BY ALL"""
)
def scenario_sampling(spark, sf_dir):
    """Cases of 4,000 sampled scenarios; first-time buyers are told by their n/a answers, or the hash where nothing is asked."""
    rows = scenarios.sample_scenarios(spark, 4000)
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("0"), F.lit("first"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0) < 0.3
    return rows.groupBy(F.regexp_replace("case", "_first_time$", "").alias("case"), first.alias("first")).agg(F.count("*").alias("n"))


_ASKED = scenarios.SITUATIONS | scenarios.NOT_NOW
_MODES = ", ".join(f"({q(m)}, {q(scenarios.DIRECTIVES[m])}, [{', '.join(q(x) for x, _ in ms)}], [{', '.join('NULL' if y is None else q(y) for _, y in ms)}]::VARCHAR[])" for m, ms in _ASKED.items())


@query(
    f"""WITH m AS (SELECT id, mode, directive, ms, anchors, ('0x' || md5('0|' || mode || '|' || id)[1:8])::BIGINT % len(ms) + 1 AS k, {hash_pick_sql([_B, _F, _L], "'0|bad|' || mode || '|' || id")} AS bad FROM (VALUES {_MODES}) AS m(mode, directive, ms, anchors), range(60) AS r(id))
SELECT id, mode, directive, ms[k] AS latest, anchors[k] AS anchor, {hash_pick_sql(scenarios.AGENTS, "'agent|' || mode || '|' || id")} AS agent, {hash_pick_sql(scenarios.CLIENTS, "'client|' || mode || '|' || id")} AS client,
CASE mode WHEN 'not_now' THEN 'ineligible' WHEN 'post_handoff' THEN 'eligible' ELSE 'qualifying' END AS stage, CASE WHEN mode IN ('not_now', 'post_handoff') THEN 'N/A' ELSE 'property_use' END AS next_key,
CASE mode WHEN 'not_now' THEN 'property_use=primary residence, ' || bad || '=yes' WHEN 'post_handoff' THEN 'property_use=primary residence, {_B}=no, {_F}=no, {_L}=no' ELSE 'N/A' END AS answers,
CASE WHEN mode <> 'not_now' THEN 'N/A' WHEN bad = '{_B}' THEN 'bankruptcy_within_3yr' WHEN bad = '{_F}' THEN 'foreclosure_within_2yr' ELSE 'late_mortgage_within_12mo' END AS reason FROM m"""
)
def situational_scenarios(spark, sf_dir):
    out = scenarios.situations(spark, messages=_ASKED)
    return out.select("id", "mode", "directive", "latest", "anchor", "agent", "client", "stage", "next_key", "answers", "reason")


# ---- labelled records ---------------------------------------------------------------------

BANK = bank.values(bank.ROWS, bank.NAMES)
N = len(bank.ROWS)
RECORDS = f"records AS (SELECT conv_id * 1000 + turn AS id, bank.* EXCLUDE (i) FROM conversations JOIN {BANK} ON i = (7 * conv_id + 3 * turn) % {N})"


def records(spark, sf_dir) -> DataFrame:
    """Labelled records: the bank's rows, one for each turn."""
    rows = bank.attach(table(spark, sf_dir, "conversations").select("conv_id", "turn"), bank.frame(spark, bank.ROWS, bank.NAMES), N)
    recs = F.array(*[F.struct(F.col(f"s{k}").alias("suggested_message"), F.col(f"c{k}").alias("confidence")) for k in (1, 2, 3)])
    return rows.withColumn("id", F.col("conv_id") * 1000 + F.col("turn")).withColumns({"recommendations": recs, "answers": F.lit("N/A"), "reason": F.lit("N/A"), "agent": F.lit("Alex")}).drop("conv_id", "turn")


def _message_sql(k: int) -> str:
    s, c = f"s{k}", f"c{k}"
    t = rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"
    return rf"""CASE WHEN {t} = '' THEN 'empty suggested_message' WHEN {c} NOT IN ('high', 'medium', 'low') THEN 'bad confidence ''' || {c} || '''' WHEN length({s}) > 400 THEN 'message too long'
WHEN len(regexp_extract_all({t}, '[.!?][\s\x0b\x{{85}}\p{{Z}}]+')) + 1 > 3 THEN 'more than 3 sentences' WHEN regexp_matches({s}, {q(audit.RATE)}) THEN 'mentions rate/APR/$ amount' WHEN regexp_matches({s}, {q(audit.TOKEN)}) THEN 'contains a redaction placeholder token (e.g. {{NAME}})' END"""


_any = lambda p: "(" + " OR ".join(f"regexp_matches(s{k}, {q(p)})" for k in (1, 2, 3)) + ")"
_word = lambda k: rf"regexp_replace(lower(regexp_extract(s{k}, '^\s*(\S+)', 1)), '^[.,!?]+|[.,!?]+$', '', 'g')"
REASON = f"""coalesce({_message_sql(1)}, {_message_sql(2)}, {_message_sql(3)}, CASE WHEN {_word(1)} = {_word(2)} AND {_word(1)} = {_word(3)} THEN 'all 3 start with the same word'
WHEN {" + ".join(f"regexp_matches(s{k}, {q(audit.ACKNOWLEDGE)})::INT" for k in (1, 2, 3))} >= 2 THEN '2+ suggestions open with call-style acknowledgement filler'
WHEN lower(stage) = 'ineligible' AND {_any(audit.HARSH)} THEN 'ineligible message uses forbidden word'
WHEN lower(is_first) = 'yes' AND regexp_matches(latest, {q(audit.HELLO)}) AND NOT ({" AND ".join(f"contains(lower(s{k}), {q(COMPANY.lower())})" for k in (1, 2, 3))}) THEN {q(f"greeting message missing '{COMPANY}'")}
WHEN mode = 'empathy' AND {_any(audit.SCREEN)} THEN 'empathy reply still qualifies/pitches (must not sell)'
WHEN mode = 'stop' AND ({" OR ".join(f"contains(s{k}, '?') OR length(s{k}) > 140" for k in (1, 2, 3))}) THEN 'stop reply is not a clean, question-free acknowledgement'
WHEN mode IN ('logistics', 'objection', 'other_lender') AND {_any(audit.SCREEN)} THEN mode || ' reply pushes a screening question (should not)' END)"""
AUDITED = f"{RECORDS}, audited AS (SELECT *, {REASON} AS reject_reason FROM records)"


@query(f"WITH {AUDITED} SELECT id, reject_reason FROM audited")
def audit_reasons(spark, sf_dir):
    return audit.audited(records(spark, sf_dir)).select("id", "reject_reason")


@query(
    rf"""WITH x AS (SELECT conv_id, turn, regexp_extract(t, '(?s)\{{.*\}}', 0) AS t FROM conversations JOIN {bank.values([(t,) for t in bank.RAWS], ['t'])} ON i = (7 * conv_id + 3 * turn) % {len(bank.RAWS)}),
l AS (SELECT conv_id, turn, CASE WHEN json_valid(t) AND json_type(t, '$.recommendations') = 'ARRAY' THEN json_array_length(t, '$.recommendations')::VARCHAR ELSE 'n/a' END AS n, t FROM x),
e AS (SELECT conv_id, turn, min(CASE WHEN json_type(r.value, '$.suggested_message') IS DISTINCT FROM 'VARCHAR' THEN r.key::INT * 10 + 1 WHEN json_type(r.value, '$.confidence') IS DISTINCT FROM 'VARCHAR' THEN r.key::INT * 10 + 2 END) AS broken
  FROM l, json_each(CASE WHEN n = '3' THEN t ELSE '{{}}' END, '$.recommendations') AS r GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN n <> '3' THEN 'not exactly 3 recommendations (' || n || ')' WHEN broken % 10 = 1 THEN 'empty suggested_message' WHEN broken % 10 = 2 THEN 'bad confidence ''''' END AS reject_reason FROM l LEFT JOIN e USING (conv_id, turn)"""
)
def audit_of_answers(spark, sf_dir):
    """The gate over raw answers: only strings are messages, only lists of three pass."""
    rows = bank.attach(table(spark, sf_dir, "conversations").select("conv_id", "turn"), bank.frame(spark, [(t,) for t in bank.RAWS], ["raw"]), len(bank.RAWS))
    recs = rows.withColumns({"recommendations": prompts.recommendations(prompts.json_object(F.col("raw"))), "stage": F.lit("qualifying"), "latest": F.lit("x"), "is_first": F.lit("no"), "mode": F.lit(None).cast("string")})
    return audit.audited(recs).select("conv_id", "turn", "reject_reason")


@query(f"WITH {AUDITED} SELECT count(*) AS labelled, count(*) FILTER (reject_reason IS NULL) AS passed, count(*) FILTER (reject_reason IS NOT NULL) AS rejected, round(100 * count(*) FILTER (reject_reason IS NULL) / count(*), 1) AS percent FROM audited")
def audit_pass_rate(spark, sf_dir):
    return audit.pass_rate(audit.audited(records(spark, sf_dir)))


@query(f"WITH {AUDITED} SELECT id, reject_reason, CASE WHEN reject_reason IS NULL THEN 'pass' ELSE 'fail' END AS verdict, reject_reason IS NULL AS ok FROM audited")
def crosscheck(spark, sf_dir):
    return audit.crosscheck(audit.audited(records(spark, sf_dir))).select("id", "reject_reason", "verdict", "ok")


@query(f"WITH {AUDITED}, r AS (SELECT unnest(['det:' || reject_reason[1:40], 'judge:deterministic']) AS reason FROM audited WHERE reject_reason IS NOT NULL) SELECT reason, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, reason LIMIT 15")
def top_reject_reasons(spark, sf_dir):
    return audit.top_reasons(audit.crosscheck(audit.audited(records(spark, sf_dir))))


_CTX = "concat_ws(chr(10), '--- CURRENT CONTEXT ---', " + ", ".join(f"{q(label + ': ')} || {c}" for c, label in (("stage", "Stage"), ("next_key", "Next question key"), ("'N/A'", "Answers collected"), ("'N/A'", "Ineligibility reason"), ("'Alex'", "Agent name"), ("client", "Client name"), ("latest", "Client's latest message"), ("is_first", "Is first message"))) + ", '---')"
USER = f"{_CTX} || CASE WHEN directive <> '' THEN chr(10) || chr(10) || directive ELSE '' END"


@query(f"WITH {RECORDS} SELECT id, {_CTX} AS context FROM records")
def context_render(spark, sf_dir):
    return records(spark, sf_dir).select("id", prompts.context_block().alias("context"))


def prompt_texts(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).select("id", prompts.prompt_scenario().alias("prompt"))


_JUDGE = "concat_ws(chr(10), replace(" + _CTX + ", 'CURRENT CONTEXT', 'CONTEXT'), CASE WHEN directive <> '' THEN chr(10) || directive END, chr(10) || '--- SUGGESTIONS ---', '1. (' || c1 || ') ' || s1, '2. (' || c2 || ') ' || s2, '3. (' || c3 || ') ' || s3)"


@query(f"WITH {RECORDS} SELECT id, {_JUDGE} AS prompt FROM records")
def judge_render(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.substring_index(prompts.prompt_judge(), "\n\nTASK: ", 1).alias("prompt"))


_TASK = bank.quote("\n".join(["", "TASK: write exactly 3 suggested messages for this context.", prompts.NO_TOKENS, prompts.NO_NODS, prompts.ASK]))


@query(f"WITH {RECORDS} SELECT id, {_CTX} || chr(10) || {_TASK} AS prompt FROM records")
def prompt_render(spark, sf_dir):
    return prompt_texts(spark, sf_dir)


@query(
    f"""WITH {RECORDS} SELECT id, {_CTX} || chr(10) || chr(10) || directive || CASE WHEN mode <> '' THEN chr(10) || chr(10) || 'One suggestion should say, as a text message: "' || mode || '".' ELSE '' END || chr(10) || chr(10) || {bank.quote(chr(10).join(["Write exactly 3 suggested messages that follow the situation.", prompts.NO_TOKENS, prompts.NO_NODS, prompts.ASK]))} AS prompt FROM records"""
)
def situation_prompt(spark, sf_dir):
    """The prompt of situations, the mode playing the anchor."""
    return records(spark, sf_dir).select("id", prompts.prompt_situation(F.col("mode")).alias("prompt"))


@query(
    f"""WITH {CANDIDATES}, lines AS (SELECT conv_id, turn, CASE role WHEN 'client' THEN 'CLIENT: ' ELSE 'REP: ' END || text AS line FROM merged),
h AS (SELECT c.conv_id, turn_idx, any_value(gold_reply) AS gold, string_agg(line, chr(10) ORDER BY turn) AS ls FROM candidates c JOIN lines l ON c.conv_id = l.conv_id AND turn < turn_idx GROUP BY c.conv_id, turn_idx)
SELECT conv_id, turn_idx, md5('Agent name: Alex' || chr(10) || 'Client name: ' || CASE WHEN conv_id % 2 = 0 THEN 'Nora' ELSE 'there' END || chr(10) || chr(10) || '--- CONVERSATION SO FAR ---' || chr(10) || ls || chr(10) || chr(10) || '--- SENT NEXT ---' || chr(10) || gold || chr(10) || chr(10)
|| {bank.quote(chr(10).join(["TASK: infer the context of the next turn, then write exactly 3 suggestions, one of them a cleaned version of what was sent.", prompts.NO_TOKENS, prompts.NO_NODS, prompts.ASK_CONTEXT]))}) AS digest FROM h"""
)
def conversation_prompt(spark, sf_dir):
    m = merged(spark, sf_dir)
    rows = tasks.with_history(tasks.candidates(m), conversation.fold(m)).withColumns({"agent_name": F.lit(None).cast("string"), "client_name": F.when(F.col("conv_id") % 2 == 0, "Nora")})
    return rows.select("conv_id", "turn_idx", F.md5(prompts.prompt_conversation()).alias("digest"))


@query(f"WITH {RECORDS} SELECT id FROM records WHERE ceil(length({_CTX} || chr(10) || {_TASK}) / 4) <= 1100 - 700 - 256")
def token_budget(spark, sf_dir):
    rows = records(spark, sf_dir)
    return prompts.within_budget(rows, prompts.prompt_scenario(), 1100).select("id")


@query(f"WITH {CANDIDATES}, l AS (SELECT c.*, m.text AS said FROM candidates c JOIN merged m ON m.conv_id = c.conv_id AND m.turn = turn_idx - 1) SELECT conv_id, turn_idx, said[1:60] AS latest, gold_reply[1:160] AS first_suggestion, 'convo' AS kind FROM l")
def dry_label(spark, sf_dir):
    out = prompts.dry_label(tasks.candidates(merged(spark, sf_dir), last=30))
    return out.select("conv_id", "turn_idx", "latest", F.get("recommendations", F.lit(0))["suggested_message"].alias("first_suggestion"), "kind")


WRAPPED = ["```json\n{\"a\": 1}\n```", "text {\"b\": {\"c\": 2}} tail", "none at all", "{broken", "} {"]


@query(rf"SELECT conv_id, turn, nullif(regexp_extract(regexp_replace(t, '(?m)^```(?:json)?|```$', '', 'g'), '(?s)\{{.*\}}', 0), '') AS object FROM conversations JOIN {bank.values([(t,) for t in WRAPPED], ['t'])} ON i = (7 * conv_id + 3 * turn) % {len(WRAPPED)}")
def json_extract(spark, sf_dir):
    rows = bank.attach(table(spark, sf_dir, "conversations"), bank.frame(spark, [(t,) for t in WRAPPED], ["t"]), len(WRAPPED))
    return rows.select("conv_id", "turn", prompts.json_object(F.col("t")).alias("object"))


@query(f"""WITH {CANDIDATES}, {SCENARIOS} SELECT kind, count(*) AS n, count(gold_reply) AS replies FROM (SELECT gold_reply, 'convo' AS kind FROM candidates UNION ALL SELECT NULL, kind FROM scenarios UNION ALL SELECT NULL, 'situation' FROM range({60 * len(scenarios.SITUATIONS)})) GROUP BY 1""")
def union_tasks(spark, sf_dir):
    all_tasks = tasks.union_tasks(tasks.candidates(merged(spark, sf_dir)), scenarios.enumerate_scenarios(spark), scenarios.situations(spark).drop("id"))
    return all_tasks.groupBy("kind").agg(F.count("*").alias("n"), F.count("gold_reply").alias("replies"))


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 200")
def head_limit(spark, sf_dir):
    return tasks.head(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 200, "conv_id", "turn")


# ---- chat records and cleaner ---------------------------------------------------------------


def chats(spark, sf_dir) -> DataFrame:
    """Chat records; where the bank has a raw reply, that one."""
    rows = sft.chat(records(spark, sf_dir), "Follow the rules.")
    return rows.withColumn("reply", F.when(F.col("raw") != "", F.col("raw")).otherwise(F.col("reply")))


@query(rf"WITH {RECORDS} SELECT id, {USER} AS user, [regexp_replace(s1, '^\s+|\s+$', '', 'g'), regexp_replace(s2, '^\s+|\s+$', '', 'g'), regexp_replace(s3, '^\s+|\s+$', '', 'g')] AS suggestions FROM records")
def sft_build(spark, sf_dir):
    rows = sft.chat(records(spark, sf_dir), "Follow the rules.")
    return rows.select("id", "user", prompts.recommendations(F.col("reply"))["suggested_message"].alias("suggestions"))


@query("SELECT conv_id, turn, CASE WHEN row_number() OVER (ORDER BY md5('0|' || conv_id || '-' || turn)) <= greatest(1, floor(count(*) OVER () * 0.03)) THEN 'val' ELSE 'train' END AS split FROM conversations")
def train_val_split(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return sft.split(rows, F.concat_ws("-", "conv_id", "turn"))


@query(rf"WITH {RECORDS} SELECT id, client AS name, next_key AS qkey, trim(latest) AS latest, is_first, regexp_extract(directive, '(?m)^SITUATION.*$', 0) AS sit FROM records")
def context_parse(spark, sf_dir):
    u = F.col("user")
    value = lambda k: cleaner.context_value(u, prompts.FIELDS[k])
    return chats(spark, sf_dir).select("id", value("client").alias("name"), value("next_key").alias("qkey"), value("latest").alias("latest"), value("is_first").alias("is_first"), cleaner.situation(u).alias("sit"))


# The cleaner in SQL. Patterns avoid lookahead: the tail is captured and put back.
def _name_sql(s: str) -> str:
    n = "regexp_escape(client)"
    c = rf"regexp_replace({s}, '^\s*(?i:hiya|heya|hey|hello|hi)\s+(?i:' || {n} || ')\b[\s,!.:-]*', '')"
    c = rf"regexp_replace({c}, '^\s*' || {n} || '\s*[,!:-]+\s*', '')"
    c = rf"regexp_replace({c}, '\s*,\s*' || {n} || '([\s.!?,]|$)', '\1', 'g')"
    c = rf"regexp_replace({c}, '\s+' || {n} || '\s*([.!?])\s*$', '\1')"
    return f"CASE WHEN lower(is_first) IN ('yes', 'true') OR client = '' OR lower(client) = 'n/a' THEN {s} ELSE {c} END"


def _openers_sql(s: str) -> str:
    return f"regexp_replace({s}, {q(cleaner.OPENERS)}, '')"


def _tidy_sql(s: str) -> str:
    c = rf"regexp_replace(regexp_replace({s}, '^[\s.,;:!?—-]+', ''), '^[ \t—,;:-]+|[ \t—,;:-]+$', '', 'g')"
    c = rf"trim(regexp_replace(regexp_replace({c}, '\s+([.,;:!?])', '\1', 'g'), '\s{{2,}}', ' ', 'g'))"
    return rf"(SELECT CASE WHEN regexp_matches(z, '[A-Za-z]') THEN regexp_extract(z, '^([^A-Za-z]*)', 1) || upper(regexp_extract(z, '([A-Za-z])', 1)) || regexp_extract(z, '(?s)^[^A-Za-z]*[A-Za-z](.*)$', 1) ELSE z END FROM (SELECT {c} AS z))"


_strip = lambda s: rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"


@query(f"WITH {RECORDS}, m AS (SELECT id, client, is_first, {_strip('s1')} AS s FROM records) SELECT id, {_name_sql('s')} AS dropped FROM m")
def dename(spark, sf_dir):
    return records(spark, sf_dir).select("id", cleaner.drop_name(strip(F.col("s1")), F.col("client"), F.lower("is_first").isin("yes", "true")).alias("dropped"))


@query(f"WITH {RECORDS} SELECT id, {_openers_sql('s1')} AS a, {_openers_sql('s2')} AS b, {_tidy_sql('s3')} AS c FROM records")
def strip_fillers(spark, sf_dir):
    return records(spark, sf_dir).select("id", cleaner.drop_openers(F.col("s1")).alias("a"), cleaner.drop_openers(F.col("s2")).alias("b"), cleaner.tidy(F.col("s3")).alias("c"))


_POOL = "[" + ", ".join(map(q, cleaner.COMFORT)) + "]"
_PICKED = lambda h: "[" + ", ".join(f"({_POOL})[((('0x' || {h}[32:32])::BIGINT % 8 + {k} * (1 + list_sum(list_transform(range(1, 33), lambda k: ('0x' || {h}[k:k])::BIGINT)) % 3)) % 8 + 1)::INTEGER]" for k in range(3)) + "]"


@query(f"WITH {RECORDS}, h AS (SELECT id, md5({USER}) AS h FROM records WHERE regexp_matches(latest, {q(cleaner.GRIEF)}) AND NOT regexp_matches(latest, {q(cleaner.LOGISTICS)})) SELECT id, {_PICKED('h')} AS messages FROM h")
def grief_relabel_pick3(spark, sf_dir):
    out = cleaner.clean(chats(spark, sf_dir), "id", cap=1 << 30)
    return out.where("outcome = 'relabelled'").select("id", F.col("messages_out").alias("messages"))


_NEW = [_tidy_sql(_openers_sql(f"(SELECT {_name_sql(f't{k}')})")) for k in (1, 2, 3)]
_ASKS = "(" + " OR ".join(f"contains(n{k}, '?')" for k in (1, 2, 3)) + ")"
_Q = "CASE next_key " + " ".join(f"WHEN '{k}' THEN {q(v[0].lower() + v[1:])}" for k, v in cleaner.QUESTIONS.items()) + " END"
CLEANED = rf"""{RECORDS}, t AS (SELECT *, {USER} AS usr, {", ".join(_strip(f"s{k}") + f" AS t{k}" for k in (1, 2, 3))}, lower(regexp_extract(directive, '(?m)^SITUATION.*$', 0)) AS sit FROM records),
n AS (SELECT *, {", ".join(f"{x} AS n{k}" for k, x in enumerate(_NEW, 1))} FROM t),
e AS (SELECT *, CASE WHEN raw <> '' THEN 'unparsable' WHEN regexp_matches(latest, {q(cleaner.GRIEF)}) AND NOT regexp_matches(latest, {q(cleaner.LOGISTICS)}) THEN 'relabelled'
WHEN regexp_matches(latest, {q(cleaner.GRIEF)}) AND ({" OR ".join(f"regexp_matches(t{k}, {q(cleaner.PITCH)})" for k in (1, 2, 3))}) THEN 'grief_mixed_logistics'
WHEN regexp_matches(sit, {q("|".join(map(re.escape, cleaner.ROUTED)))}) THEN 'spec_sensitive' WHEN {" OR ".join(f"regexp_matches(t{k}, {q(cleaner.HUMAN)})" for k in (1, 2, 3))} THEN 'guardrail_humanity' END AS early,
{" OR ".join(rf"len(regexp_extract_all(n{k}, '\w+')) < 3" for k in (1, 2, 3))} AS short FROM n),
c AS (SELECT *, early IS NULL AND NOT short AND regexp_matches(sit, {q("|".join(map(re.escape, cleaner.CIRCLE)))}) AND next_key <> '' AND NOT {_ASKS} AS circled FROM e),
o AS (SELECT *, CASE WHEN early = 'relabelled' THEN (SELECT {_PICKED("h")} FROM (SELECT md5(usr) AS h)) WHEN early IS NULL THEN [CASE WHEN circled AND {_Q} IS NOT NULL THEN regexp_replace(n1, '[ .!]+$', '') || '. Anyway - ' || {_Q} ELSE n1 END, n2, n3] END AS msgs FROM c),
f AS (SELECT *, coalesce(early, CASE WHEN short THEN 'degenerate_after_strip' WHEN len(list_distinct(msgs)) < 3 THEN 'collapsed_duplicates' ELSE 'kept' END) AS outcome0 FROM o),
cleaned AS (SELECT id, circled, coalesce(early = 'relabelled', false) AS relabelled, usr, t1, t2, t3, client, is_first, CASE WHEN outcome0 IN ('kept', 'relabelled') THEN msgs END AS messages_out, outcome0 IN ('kept', 'relabelled') AND msgs <> [t1, t2, t3] AS modified,
CASE WHEN outcome0 IN ('kept', 'relabelled') AND row_number() OVER (PARTITION BY outcome0 IN ('kept', 'relabelled'), usr, msgs ORDER BY id) > 3 THEN 'dup_capped' ELSE outcome0 END AS outcome FROM f)"""


@query(f"WITH {CLEANED} SELECT id, outcome, circled, modified, messages_out FROM cleaned")
def regen_routing(spark, sf_dir):
    return cleaner.clean(chats(spark, sf_dir), "id").select("id", "outcome", "circled", "modified", "messages_out")


_ROUTES = ("grief_mixed_logistics", "spec_sensitive", "guardrail_humanity", "degenerate_after_strip", "collapsed_duplicates")


@query(
    f"WITH {CLEANED}, r AS (SELECT count(*) AS total, count(*) FILTER (outcome = 'unparsable') AS unparsable_dropped, count(*) FILTER (modified) AS records_modified, count(*) FILTER (circled) AS circle_back_added, count(*) FILTER (outcome = 'dup_capped') AS dup_capped, count(*) FILTER (relabelled) AS grief_relabeled, "
    f"count(*) FILTER (outcome IN ('kept', 'relabelled')) AS kept, count(*) FILTER (outcome IN ({', '.join(map(q, _ROUTES))})) AS routed_to_regen, {', '.join(f'count(*) FILTER (outcome = {q(x)}) AS {x}' for x in _ROUTES)} FROM cleaned) SELECT metric, value FROM (UNPIVOT r ON COLUMNS(*) INTO NAME metric VALUE value)"
)
def clean_report(spark, sf_dir):
    return cleaner.report(cleaner.clean(chats(spark, sf_dir), "id"))


def _quality_sql(src: str, texts: str, where: str) -> str:
    has = lambda p, x="x": f"regexp_matches({x}, {q(p)})"
    rest, named = "lower(is_first) NOT IN ('yes', 'true')", f"client <> '' AND lower(client) <> 'n/a' AND len(list_filter({texts}, lambda x: contains(lower(x), lower(client)))) > 0"
    return f"""SELECT *, fillers / greatest(suggestions, 1) AS filler_rate, named / greatest(not_first, 1) AS name_rate, greeted / greatest(not_first, 1) AS greeting_rate FROM (SELECT '{src}' AS phase, count(*) AS records, sum(len({texts}))::BIGINT AS suggestions, sum(len(list_filter({texts}, lambda x: {has(cleaner.FILLER)})))::BIGINT AS fillers,
sum(len(list_filter({texts}, lambda x: {has("^[" + chr(92) + "s.,;:!?]")} OR contains(x, '  '))))::BIGINT AS artifacts, count(*) FILTER ({rest}) AS not_first, count(*) FILTER ({rest} AND {named}) AS named,
count(*) FILTER ({rest} AND len(list_filter({texts}, lambda x: {has(cleaner.GREETING)})) > 0) AS greeted FROM cleaned WHERE {where})"""


@query(f"WITH {CLEANED} {_quality_sql('before', '[t1, t2, t3]', 'outcome <> ' + q('unparsable'))} UNION ALL {_quality_sql('after', 'messages_out', 'outcome IN (' + q('kept') + ', ' + q('relabelled') + ')')}")
def before_after_metrics(spark, sf_dir):
    out = cleaner.clean(chats(spark, sf_dir), "id").withColumn("texts", F.transform("recommendations", lambda r: strip(r["suggested_message"])))
    phase = lambda name, when, texts: F.struct(F.lit(name).alias("phase"), F.when(F.expr(when), F.col(texts)).alias("texts"))
    phases = F.explode(F.array(phase("before", "outcome <> 'unparsable'", "texts"), phase("after", "outcome IN ('kept', 'relabelled')", "messages_out")))
    rows = out.select("client", "is_first", phases.alias("p")).select("client", "is_first", "p.*").where("texts IS NOT NULL")
    return cleaner.quality(rows, "texts", "client", "is_first", by=("phase",))


@query("SELECT doc_id, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) <= 3")
def dup_cap(spark, sf_dir):
    return cleaner.cap_duplicates(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest")), ["digest"], "doc_id")


@query(f"WITH {CANDIDATES}, {AUDITED} SELECT * FROM (VALUES (0, 'turns', (SELECT count(*) FROM conversations)), (1, 'merged', (SELECT count(*) FROM merged)), (2, 'tasks', (SELECT count(*) FROM candidates)), (3, 'passed', (SELECT count(*) FROM audited WHERE reject_reason IS NULL)), (4, 'missing', NULL)) AS f(step, stage, n)")
def funnel_counts(spark, sf_dir):
    m = merged(spark, sf_dir)
    stages = {"turns": table(spark, sf_dir, "conversations"), "merged": m, "tasks": tasks.candidates(m), "passed": audit.audited(records(spark, sf_dir)).where("reject_reason IS NULL"), "missing": None}
    return metrics.funnel(stages, spark)


@query(
    """SELECT round(max(event_id) / 1000, 2) AS epochs, max(event_id) AS global_steps, arg_min(value, event_id) FILTER (event_id % 3 <> 0) AS first_loss, arg_max(value, event_id) FILTER (event_id % 3 <> 0) AS last_loss,
arg_max(value, event_id) FILTER (event_id % 3 = 0) AS last_eval, max(value) AS max_rate, arg_max(event_id * 0.5::DOUBLE, event_id) FILTER (event_id % 50 = 7) AS samples_per_second, arg_max(event_id * 0.25::DOUBLE, event_id) FILTER (event_id % 50 = 7) AS steps_per_second,
(s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' AS runtime FROM events, (SELECT max(event_id) FILTER (event_id % 50 = 7) * 3 AS s FROM events) GROUP BY s"""
)
def loss_summary(spark, sf_dir):
    """A training log played by the events table."""
    n, v = F.col("event_id"), F.col("value")
    final = lambda x: F.when(n % 50 == 7, x)
    log = table(spark, sf_dir, "events").select(
        n.alias("step"), F.when(n % 3 != 0, v).alias("loss"), F.when(n % 3 == 0, v).alias("eval_loss"), v.alias("learning_rate"), (n / 1000).alias("epoch"), n.alias("global_step"),
        final(n * 3.0 + 0.5).alias("train_runtime"), final(n * 0.5).alias("train_samples_per_second"), final(n * 0.25).alias("train_steps_per_second"),
    )
    return metrics.loss_summary(log)


#: What the model test makes of the answers of bank.RAWS, written out by hand: n_suggestions, ok, error, then messages and confidences.
_Q1, _Q2, _Q3 = ("Which street is it on?", "high"), ("When would you move?", "low"), ("Shall we talk on Sunday?", "medium")
_E = ("", "")
_JUDGED = [
    (3, 1, "", _Q1, _Q2, _Q3), (3, 1, "", _Q1, _Q2, _Q3), (3, 1, "", ("5", "high"), _Q2, _Q3), (3, 1, "", _Q1, _Q2, ("true", "low")), (3, 1, "a recommendation is not an object", _Q1, _Q2, _E), (1, 1, "", _Q1, _E, _E),
    (0, 1, "recommendations is not a list", _E, _E, _E), (0, 1, "", _E, _E, _E), (0, 0, "no JSON object in the answer", _E, _E, _E), (3, 1, "", ("When?", "3"), _Q2, _Q3), (3, 1, "", ("", "low"), _Q2, _Q3),
]
_JUDGED_SQL = bank.values([(r, n, ok, e, *a, *b, *c) for r, (n, ok, e, a, b, c) in zip(bank.RAWS, _JUDGED, strict=True)], ["raw_response", "n_suggestions", "ok", "error", *(f"{x}_{k}" for k in (1, 2, 3) for x in ("suggestion", "confidence"))], "judged")


@query(
    f"""WITH {RECORDS} SELECT id AS idx, 'scenario' AS kind, '' AS "case", stage, next_key, 'N/A' AS answers_collected, 'N/A' AS ineligibility_reason, latest AS client_latest, is_first, 'Alex' AS agent, client, judged.* EXCLUDE (i)
FROM records JOIN {_JUDGED_SQL} ON judged.i = length({_CTX} || chr(10) || {_TASK}) % {len(bank.RAWS)}"""
)
def model_evaluation(spark, sf_dir):
    """Flat rows of an evaluation with an injected model, which answers by the length of the prompt."""
    answers = prompts.labelled(records(spark, sf_dir).withColumn("kind", F.lit("scenario")), prompts.prompt_scenario(), lambda ps: [bank.RAWS[len(p) % len(bank.RAWS)] for p in ps])
    return prompts.evaluation_rows(answers)


_GIVEN = '{"context": {"Stage": "confirming", "Client\'s latest message": "yes", "Agent name": "Nobody"}, "recommendations": []}'


@query(
    f"""WITH {RECORDS}, k AS (SELECT *, CASE id % 3 WHEN 0 THEN 'scenario' WHEN 1 THEN 'situation' ELSE 'convo' END AS kind FROM records)
SELECT id, CASE kind WHEN 'convo' THEN 'confirming' ELSE stage END AS stage, CASE kind WHEN 'convo' THEN 'yes' ELSE latest END AS latest, CASE WHEN kind <> 'convo' THEN next_key END AS next_key, CASE kind WHEN 'convo' THEN 'Vera' ELSE 'Alex' END AS agent,
CASE kind WHEN 'convo' THEN 'there' ELSE client END AS client, CASE kind WHEN 'situation' THEN mode END AS mode, CASE kind WHEN 'situation' THEN directive END AS directive, 'scenario' AS source, 'file-' || id AS file, kind, NULL::VARCHAR AS "case" FROM k"""
)
def label_assembly(spark, sf_dir):
    """Labelled records of all kinds from a fixed answer."""
    kind = F.when(F.col("id") % 3 == 0, "scenario").when(F.col("id") % 3 == 1, "situation").when(F.col("id") % 2 == 0, "convo")
    rows = records(spark, sf_dir).withColumns({"kind": kind, "agent_name": F.lit("Vera"), "file": F.concat(F.lit("file-"), F.col("id"))})
    out = prompts.assembled(prompts.labelled(rows, prompts.prompt_scenario(), lambda ps: [_GIVEN] * len(ps)))
    return out.select(F.regexp_extract("meta.file", r"\d+", 0).cast("long").alias("id"), "stage", "latest", "next_key", "agent", "client", "mode", "directive", "meta.*")


# ---- sources and sinks ------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"query-{uuid.uuid4().hex}")


@query(rf"WITH t AS (SELECT 'thread-' || (conv_id % 40) || '.json' AS file, conv_id, turn, role, text FROM conversations WHERE conv_id % 40 % 10 <> 9) SELECT file, (row_number() OVER (PARTITION BY file ORDER BY conv_id, turn) - 1)::INTEGER AS ordinal, role, text, (conv_id * 100 + turn)::VARCHAR AS timestamp FROM t")
def thread_files(spark, sf_dir):
    """One JSON file a thread (40 threads; some use the other key, one in ten is broken), written and read again."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") % 40)
    turn = F.struct("conv_id", "turn", F.struct("role", "text", (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("timestamp")).alias("m"))
    threads = c.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["m"]).alias("ms"))
    empty = F.array().cast(files.MESSAGE)
    body = F.when(F.col("k") % 3 == 0, F.to_json(F.struct(empty.alias("chat_history"), F.col("ms").alias("messages")))).otherwise(F.to_json(F.struct(F.col("ms").alias("chat_history"))))
    body = F.when(F.col("k") % 10 == 9, F.lit("[1]")).otherwise(body)
    folder = _folder(spark)
    threads.select(F.concat(F.lit("thread-"), "k", F.lit(".json")).alias("name"), body.alias("value")).repartition("name").write.partitionBy("name").text(folder)
    read = files.read_threads(spark, f"{folder}/*/*")
    return read.select(F.regexp_extract("path", r"name=([^/]+)", 1).alias("file"), "ordinal", "role", "text", "timestamp")


@query(r"SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE turn % 4 <> 3")
def jsonl_round_trip(spark, sf_dir):
    """Records as JSON lines, plain and ASCII only, read again by the tolerant scan, which skips broken lines."""
    c, folder = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), _folder(spark)
    files.write_jsonl(c.where("turn % 4 IN (0, 2)"), f"{folder}/a")
    files.write_jsonl(c.where("turn % 4 = 1"), f"{folder}/b", ascii_only=True)
    c.where("turn % 4 = 3").select(F.lit('{"conv_id": 1, "turn": ').alias("value")).write.text(f"{folder}/c")
    read = files.read_jsonl(spark, [f"{folder}/{x}" for x in "abc"], "conv_id long, turn long, text string", tolerant=True)
    return read.select("conv_id", "turn", F.md5("text").alias("digest"))


@query("SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE text <> ''")
def csv_round_trip(spark, sf_dir):
    """All fields quoted, with a header, in order; line ends and quotes inside survive."""
    c, folder = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", "text"), _folder(spark)
    files.write_csv(c, folder, "conv_id")
    read = spark.read.csv(folder, header=True, multiLine=True, escape='"', schema="conv_id long, turn long, text string", lineSep="\n")
    return read.select("conv_id", "turn", F.md5("text").alias("digest"))


@query("SELECT role AS metric, count(*) AS value FROM conversations GROUP BY 1")
def report_round_trip(spark, sf_dir):
    """Counters as one JSON object, read again."""
    folder = _folder(spark)
    files.write_report(table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("metric")).agg(F.count("*").alias("value")), folder)
    whole = spark.read.text(folder, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, long>")).alias("metric", "value"))


@query("SELECT 'call-' || (conv_id % 40) AS file, (row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id, turn) - 1)::INTEGER AS line_no, replace(replace(text, chr(10), ' '), chr(13), ' ') AS line FROM conversations")
def transcript_files(spark, sf_dir):
    """One text file a call, written and read again line by line."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") % 40)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", F.translate("text", "\n\r", "  ").alias("t")))), lambda x: x["t"])
    folder = _folder(spark)
    c.groupBy("k").agg(F.array_join(lines, "\n").alias("value")).select(F.concat(F.lit("call-"), "k").alias("name"), "value").repartition("name").write.partitionBy("name").text(folder)
    return files.read_transcripts(spark, f"{folder}/*/*").select(F.regexp_extract("path", r"name=([^/]+)", 1).alias("file"), "line_no", "line")


@query("SELECT event_id AS step, value AS loss, 2.5::DOUBLE AS epoch, 77::BIGINT AS global_step FROM events WHERE event_id % 10 = 0")
def trainer_log(spark, sf_dir):
    """State files of two checkpoints; the one with the higher number is read."""
    log, folder = table(spark, sf_dir, "events").where("event_id % 10 = 0").select(F.struct(F.col("event_id").alias("step"), F.col("value").alias("loss")).alias("x")), _folder(spark)
    for k, shown in ((9, log.limit(1)), (12, log)):
        state = shown.agg(F.to_json(F.struct(F.lit(2.5).alias("epoch"), F.lit(77).alias("global_step"), F.collect_list("x").alias("log_history"))).alias("value"))
        state.coalesce(1).write.text(f"{folder}/checkpoint-{k}")
    return files.read_trainer_log(spark, folder, name="*.txt").select("step", "loss", "epoch", "global_step")


@query(
    f"""WITH {CANDIDATES}, picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY head DESC, md5('0|' || conv_id || '|' || turn_idx), turn_idx) AS pick
FROM (SELECT *, turn_idx = min(turn_idx) OVER (PARTITION BY conv_id) AS head FROM candidates)) WHERE pick <= 6),
dry AS (SELECT p.conv_id, turn_idx, m.text[1:60] AS latest, gold_reply[1:160] AS s1, 'which number is best to reach you?' AS s2, 'glad to go on whenever you like' AS s3, 'medium' AS c1, 'low' AS c2, 'low' AS c3,
'qualifying' AS stage, 'N/A' AS next_key, 'there' AS client, CASE WHEN is_first THEN 'yes' ELSE 'no' END AS is_first, NULL::VARCHAR AS mode, '' AS directive FROM picked p JOIN merged m ON m.conv_id = p.conv_id AND m.turn = turn_idx - 1),
passed AS (SELECT *, {USER} AS usr FROM dry WHERE {REASON} IS NULL)
SELECT conv_id, turn_idx, CASE WHEN row_number() OVER (ORDER BY md5('0|' || conv_id || '-' || turn_idx)) <= greatest(1, floor(count(*) OVER () * 0.03)) THEN 'val' ELSE 'train' END AS split, usr AS user, [{_strip('s1')}, s2, s3] AS suggestions FROM passed"""
)
def conversations_to_chat(spark, sf_dir) -> DataFrame:
    """Flagship: conversations cleaned and merged, tasks built and capped, labelled by the dry labeler, audited, rendered, split."""
    capped = tasks.head_and_sample(tasks.candidates(merged(spark, sf_dir), last=30), 6)
    dry = prompts.dry_label(capped)
    ctx = dry.withColumns({"stage": F.lit("qualifying"), "next_key": F.lit("N/A"), "answers": F.lit("N/A"), "reason": F.lit("N/A"), "agent": F.lit("Alex"), "client": F.lit("there"), "is_first": F.when(F.col("is_first"), "yes").otherwise("no"), "mode": F.lit(None).cast("string"), "directive": F.lit(None).cast("string")})
    passed = audit.audited(ctx).where("reject_reason IS NULL")
    rows = sft.split(sft.chat(passed, "Follow the rules."), F.concat_ws("-", "conv_id", "turn_idx"))
    return rows.select("conv_id", "turn_idx", "split", "user", prompts.recommendations(F.col("reply"))["suggested_message"].alias("suggestions"))
