import json
import struct

import pytest
from pyspark.sql import functions as F

from threadloom.operators import audit, cleaner, conversation, metrics, prompts, scenarios, sft, surrogates, tasks
from threadloom.plans import queries
from threadloom.sources import files
from threadloom.streaming import stateless


def test_enumeration_counts(spark):
    want = dict(casual=40, confirming=240, confirming_first_time=160, eligible=192, eligible_first_time=128, greeting=48, ineligible=288, ineligible_first_time=64, logistics=40, offtopic=40, qualifying=672, qualifying_first_time=200)
    assert {r["case"]: r["n"] for r in metrics.histogram(scenarios.enumerate_scenarios(spark), "case").collect()} == want


def test_sampled_scenarios_are_consistent(spark):
    rows = scenarios.sample_scenarios(spark, 3000, 3).collect()
    share = sum(r["case"] == "qualifying" or r["case"] == "qualifying_first_time" for r in rows) / len(rows)
    assert 0.30 < share < 0.38 and all(r["latest"] for r in rows)
    for r in rows:
        assert (r["stage"] == "ineligible") == (r["reason"] != "N/A")
        if r["stage"] == "qualifying" and "bankruptcy_past_3yr=" in r["answers"]:
            assert "property_use=" in r["answers"]


def test_rehydrate_against_brute_force(spark):
    import hashlib

    turns = [("f1", k, t) for k, t in enumerate(queries.TOKENS)] + [("f2", 0, "{NAME} and {EMAIL} and {NAME}"), ("f2", 1, "ask {NAME_FAMILY}"), ("f2", 2, None)]
    got = surrogates.rehydrate(spark.createDataFrame(turns, "file string, turn int, text string")).orderBy("file", "turn").collect()
    for r in got:
        pool = sorted(surrogates.NAMES, key=lambda n: hashlib.md5(f"{r['file']}|{n}".encode()).hexdigest())
        assert [r["agent_name"], r["client_name"]] == pool[:2]
    pool = sorted(surrogates.NAMES, key=lambda n: hashlib.md5(f"f2|{n}".encode()).hexdigest())
    assert got[-3]["text"] == f"{pool[2]} and {pool[4].lower()}@example.com and {pool[3]}"
    assert got[-2]["text"] == f"ask {pool[5]}" and got[-1]["text"] is None
    assert surrogates.leaks(spark.createDataFrame([(r["text"],) for r in got], "text string")).first()["leaking"] == 0


def test_redact_names(spark):
    df = spark.createDataFrame([("hey there, I'm Anna Bell and this is James. - Bob",)], "t string")
    x = df.select(surrogates.redact(F.col("t"), ["james", "anna"])).first()[0]
    assert "Anna" not in x and "James" not in x and "Bob" not in x and x.startswith("hey there, I'm ")


def test_redact_pinned(spark):
    """A known name needs a capital and small letters; what the rules put between is theirs; accents are letters."""
    import hashlib

    pick = lambda name: surrogates.MINED[int(hashlib.md5(name.lower().encode()).hexdigest()[:8], 16) % len(surrogates.MINED)]
    cases = [
        ("the grace period", "the grace period"), ("then Grace said GRACE", f"then {pick('grace')} said GRACE"), ("dear\tOtto", f"dear {pick('otto')}"), ("bye —Eva Holm", f"bye - {pick('eva holm')}"),
        ("hey there how are you", "hey there how are you"), ("mail josé.é@mañana.org now", "mail someone@example.com now"), ("call +1 (555) 123-4567", "call (555) 010-4321"), ("$ 1,200.50 at 12 N. Oak st", "$300k at a property nearby st"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = [r["x"] for r in df.select("k", surrogates.redact(F.col("t"), ["grace"]).alias("x")).orderBy("k").collect()]
    assert got == [w for _, w in cases]
    loose = df.where("k = 4").select(surrogates.redact(F.col("t"), [], loose=True).alias("x")).first()["x"]
    assert loose == f"hey {pick('there how')} are you"


def test_leak_gate(spark):
    df = spark.createDataFrame([("fine",), ("{NAME} here",), ("{NAME_1} slips by",)], "text string")
    assert surrogates.leaks(df).first().asDict() == {"texts": 3, "leaking": 1}
    assert surrogates.leaks(df, pattern=surrogates.WIDE_TOKEN).first()["leaking"] == 2
    assert surrogates.require_no_leak(df.where("text = 'fine'")).count() == 1
    with pytest.raises(Exception, match="survived"):
        surrogates.require_no_leak(df).collect()


def test_unicode_signatures(spark):
    rows = [("agent", x) for x in ("- José", "thanks, — Zoë", "– Anna", "- José left", "ok - René", "\u2003- Åsa\u00a0")]
    got = conversation.clean_sms(spark.createDataFrame(rows, "role string, text string")).collect()
    assert [r["text"] for r in got] == ["- José left", "ok - René"]


def test_head_and_sample_keeps_head(spark):
    rows = spark.createDataFrame([(1, k, k == 1, "x") for k in range(1, 12)] + [(2, 3, False, "y")], "conv_id int, turn_idx int, is_first boolean, gold_reply string")
    got = tasks.head_and_sample(rows, 3).collect()
    assert len(got) == 4 and (1, 1) in {(r["conv_id"], r["turn_idx"]) for r in got}
    with pytest.raises(ValueError):
        tasks.head_and_sample(rows, 0)


def test_audit_null_records(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None), (2, [], "x", "y", "no", None), (3, [(None, "high")] * 3, "x", None, None, None)], f"id int, recommendations {prompts.RECS}, stage string, latest string, is_first string, mode string")
    got = {r["id"]: r["reject_reason"] for r in audit.audited(rows).collect()}
    assert got == {1: "not exactly 3 recommendations (n/a)", 2: "not exactly 3 recommendations (0)", 3: "empty suggested_message"}


def test_json_strictness(spark):
    ok = '{"recommendations": [{"suggested_message": "a", "confidence": "high"}]}'
    cases = [ok, ok + " tail", "{'recommendations': []}", '{"recommendations": 3}', "", None, "[1]"]
    got = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string").select("k", prompts.recommendations(F.col("c")).alias("r")).orderBy("k").collect()
    assert [r["r"] is not None for r in got] == [True] + [False] * 6


def test_context_last_value_wins(spark):
    user = "--- CURRENT CONTEXT ---\nClient name: Ann\nClient's latest message: hi\nClient name: Bea\nSITUATION: small talk\n---"
    u = spark.createDataFrame([(user,)], "u string").select(cleaner.context_value(F.col("u"), "Client name"), cleaner.situation(F.col("u")), cleaner.context_value(F.col("u"), "Stage")).first()
    assert tuple(u) == ("Bea", "SITUATION: small talk", None)


def test_split_sizes(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    got = {r["split"]: r["count"] for r in sft.split(rows, F.col("k"), 0.03, 1).groupBy("split").count().collect()}
    assert got == {"val": 30, "train": 970}
    assert sft.split(rows.limit(0), F.col("k")).count() == 0


def test_only_strings_are_messages(spark):
    """Numbers and truth values don't pass for texts; elements that are no objects are empty ones."""
    raw = ['{"recommendations": [{"suggested_message": 5, "confidence": "high"}, 7, {"suggested_message": "a", "confidence": true}]}']
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(prompts.recommendations(F.col("r")).alias("x")).first()["x"]
    assert [tuple(r) for r in got] == [(None, "high"), (None, None), ("a", None)]
    rows = spark.createDataFrame([(1, [(None, "high"), ("a", "low"), ("b", "low")], "x", None, None, None)], f"id int, recommendations {prompts.RECS}, stage string, latest string, is_first string, mode string")
    assert audit.audited(rows).first()["reject_reason"] == "empty suggested_message"


def test_labelled_failures_are_rows(spark):
    """One prompt that fails is one row with an error; the others of its batch are answered."""
    rows = spark.createDataFrame([(1, "p"), (2, "bad"), (3, "q")], "id int, p string").coalesce(1)

    def fails(asked):
        if "bad" in asked:
            raise TimeoutError("late")
        return ['{"recommendations": []}' for _ in asked]

    got = prompts.labelled(rows, F.col("p"), fails).orderBy("id").collect()
    assert [(r["recommendations"], (r["error"] or "")[:12]) for r in got] == [([], ""), (None, "TimeoutError"), ([], "")]
    flat = prompts.evaluation_rows(prompts.labelled(rows, F.col("p"), fails)).orderBy("idx").collect()
    assert len(flat[0]) == 21 and [(r["ok"], r["error"], r["kind"]) for r in flat] == [(1, "", ""), (0, "TimeoutError: late", ""), (1, "", "")]


def test_label_assembly_defaults(spark):
    raw = '{"context": {"Stage": "eligible", "Agent name": "X", "Answers collected": "a=b"}, "recommendations": [{"suggested_message": "m", "confidence": "low"}]}'
    rows = spark.createDataFrame([(1, "scenario", "confirming"), (2, None, "confirming"), (3, "situation", "qualifying")], "id int, kind string, stage string").withColumn("directive", F.lit("D"))
    got = prompts.assembled(prompts.labelled(rows, F.lit("p"), lambda ps: [raw] * len(ps))).collect()
    assert [(r["stage"], r["agent"], r["client"], r["answers"], r["directive"], tuple(r["meta"]), len(r["recommendations"])) for r in got] == [
        ("confirming", None, None, None, None, ("scenario", None, "scenario", None), 1), ("eligible", "Alex", "there", "a=b", None, ("scenario", None, "convo", None), 1), ("qualifying", None, None, None, "D", ("scenario", None, "situation", None), 1),
    ]


def test_cleaner_counts_what_is_relabelled(spark):
    """A relabelled record counts even where the cap on duplicates drops it; rates have a denominator of one at least."""
    user = "--- CURRENT CONTEXT ---\nClient's latest message: my husband died\nClient name: Ann\n---"
    reply = json.dumps({"recommendations": [{"suggested_message": m, "confidence": "low"} for m in ("Got it, so where?", "ok  then, Ann", "When is it?")]})
    out = cleaner.clean(spark.createDataFrame([(k, user, reply) for k in range(5)], "id int, user string, reply string"), "id")
    counts = {r["metric"]: r["value"] for r in cleaner.report(out).collect()}
    assert (counts["grief_relabeled"], counts["dup_capped"], counts["kept"]) == (5, 2, 3)
    rows = spark.createDataFrame([(["Got it, where?", "ok  then, Ann", "When?"], "Ann", "no"), (["Hi Ann", "a", "b"], "Ann", "yes")], "t array<string>, n string, f string")
    got = cleaner.quality(rows, "t", "n", "f").first()
    assert (got["filler_rate"], got["name_rate"], got["greeting_rate"], got["artifacts"]) == (1 / 6, 1.0, 0.0, 1)
    assert cleaner.quality(rows.limit(0), "t", "n", "f").first()["filler_rate"] == 0.0


def test_not_now_contexts(spark):
    for r in scenarios.situations(spark, 30, messages=scenarios.NOT_NOW).collect():
        bad = r["answers"].split(", ")[1].removesuffix("=yes")
        assert (r["stage"], r["next_key"], r["reason"]) == ("ineligible", "N/A", scenarios.REASONS[bad]) and r["latest"]
    assert {r["mode"] for r in scenarios.situations(spark, 1).collect()} == set(scenarios.SITUATIONS)


def test_teacher_retries():
    from threadloom.sources import teacher

    waits, calls = [], []

    def post(url, body, timeout):
        calls.append(body)
        if len(calls) < 3:
            raise TimeoutError
        return {"choices": [{"message": {"content": "ok"}}]}

    assert teacher.server("http://x", "m", "s", workers=1, post=post, wait=waits.append)(["p"]) == ["ok"] and waits == [2, 4]
    assert teacher.server("http://x", "m", "s", post=lambda *_: {}, wait=waits.append)(["p", "q"]) == [None, None]


def test_verdicts(spark):
    raw = ['```json\n{"verdict": "fail", "violations": [{"which": "1", "rule": "voice", "detail": "d"}]}\n```', "no", None]
    got = prompts.verdicts(spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "id int, raw string")).orderBy("id").collect()
    assert [(r["verdict"], r["rule"]) for r in got] == [("fail", "voice"), ("error", None), ("error", None)]


def test_files(spark, tmp_path):
    d = tmp_path / "sms"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"chat_history": [], "messages": [{"role": "Agent ", "text": " hi\r\n there"}, {"role": "client", "text": "- Bo"}]}))
    (d / "b.json").write_text("[1, 2]")
    (d / "c.json").write_text('{"chat_history": [')
    got = conversation.clean_sms(files.read_threads(spark, str(d))).collect()
    assert [(r["file"], r["role"], r["text"]) for r in got] == [("a.json", "agent", "hi \n there")]
    assert {r["file"] for r in files.broken_threads(spark, str(d)).collect()} == {"b.json", "c.json"}
    t = tmp_path / "calls"
    t.mkdir()
    (t / "x.txt").write_text("[00:00:01] Agent: hello  there\nno stamp\n[00:00:02] Agent 1: lost\n[00:00:03] External: yeah\n[00:00:04] External: Okay.\n")
    lines = conversation.parse_call_lines(files.read_transcripts(spark, str(t))).orderBy("line_no").collect()
    assert [(r["role"], r["text"]) for r in lines] == [("agent", "hello there"), ("client", "Okay.")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int", tolerant=True).collect()) == [1, 2]
    odd = 'é 𝄞 "q" \\ \u2028 a'
    for name, plain in (("asc", True), ("uni", False)):
        files.write_jsonl(spark.createDataFrame([(odd,)], "x string"), str(tmp_path / name), ascii_only=plain)
        text = "".join(p.read_text() for p in (tmp_path / name).glob("part*"))
        assert json.loads(text) == {"x": odd} and text.isascii() == plain
    m = tmp_path / "m"
    m.mkdir()
    head = json.dumps({"__metadata__": {}, "w": {"shape": [3, 4]}, "b": {"shape": [5]}}).encode()
    (m / "a.safetensors").write_bytes(struct.pack("<Q", len(head)) + head)
    (m / "b.safetensors").write_bytes(b"xx")
    assert {r["file"]: r["parameters"] for r in files.read_parameters(spark, str(m)).collect()} == {"a.safetensors": 17, "b.safetensors": None}
    for k in (5, 12):
        c = tmp_path / "t" / f"checkpoint-{k}"
        c.mkdir(parents=True)
        (c / "trainer_state.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.0, "learning_rate": 0.1}, {"step": k, "loss": 1.0}, {"step": k, "eval_loss": float(k)}, {"step": k, "train_runtime": 3725.9, "train_samples_per_second": 8.5, "train_steps_per_second": 0.5}], "epoch": 1.996, "global_step": 100 * k}))
    got = metrics.loss_summary(files.read_trainer_log(spark, str(tmp_path / "t"))).first().asDict()
    assert got == dict(epochs=2.0, global_steps=1200, first_loss=2.0, last_loss=1.0, last_eval=12.0, max_rate=0.1, samples_per_second=8.5, steps_per_second=0.5, runtime="1h 2m 5s")
    files.write_csv(spark.createDataFrame([(2, 'say "hi"\nyou'), (1, "x")], "idx int, t string"), str(tmp_path / "csv"), "idx")
    assert "".join(p.read_text() for p in (tmp_path / "csv").glob("part*")) == '"idx","t"\n"1","x"\n"2","say ""hi""\nyou"\n'
    files.write_report(spark.createDataFrame([("kept", 3), ("all", 5)], "metric string, value long"), str(tmp_path / "rep"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "rep").glob("part*"))) == {"kept": 3, "all": 5}
    calls = []
    for _ in range(2):
        assert files.memoised(spark, str(tmp_path / "memo"), lambda: calls.append(1) or spark.range(3)).count() == 3
    assert len(calls) == 1


def test_streams(spark, tmp_path):
    src = str(tmp_path / "turns")
    spark.createDataFrame([("a", 1, "agent", "hello"), ("a", 2, "client", "stop"), ("a", 3, "system", "x"), ("a", 4, "client", "reply stop now")], "conv_id string, turn int, role string, text string").write.parquet(src)
    stream = spark.readStream.schema("conv_id string, turn int, role string, text string").parquet(src)
    for name, df, n in (("cleaned", stateless.cleaned_turns(stream), 2), ("capped", stateless.capped(stream, "conv_id", 3), 3)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n


def test_sparkline():
    assert metrics.sparkline([]) == "" and metrics.sparkline([1, 1]) == "▁▁" and metrics.sparkline([0, 7]) == "▁█"
    assert len(metrics.sparkline(list(range(500)))) == 60
