"""Plans that must hold at scale: what is read, how often rows are shuffled, what is broadcast."""

from threadloom.operators import cleaner, tasks
from threadloom.plans import queries

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_needed(spark):
    text = plan(queries.dup_cap(spark, DIR))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_filters_reach_the_scan(spark):
    text = plan(queries.turns(spark, DIR).where("conv_id = 7"))
    assert "PushedFilters: [IsNotNull(conv_id), EqualTo(conv_id,7)]" in text


def test_windows_of_a_conversation_share_one_shuffle(spark):
    merged = queries.merged(spark, DIR)
    one = plan(merged).count("Exchange hashpartitioning")
    assert plan(tasks.head_and_sample(tasks.candidates(merged), 2)).count("Exchange hashpartitioning") == one == 1


def test_cap_is_limited_before_the_shuffle(spark):
    text = plan(cleaner.cap_duplicates(queries.table(spark, DIR, "documents").select("doc_id", "text"), ["text"], "doc_id"))
    assert text.count("WindowGroupLimit") == 2


def test_no_python_in_catalyst_operators(spark):
    for name in ("turn_merge", "audit_reasons", "regen_routing", "redact_pii", "scenario_enumeration"):
        assert not any(x in plan(queries.QUERIES[name](spark, DIR)) for x in ("Python", "Pandas", "InArrow")), name
