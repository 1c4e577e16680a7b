"""Throughput of two stages against plain single-threaded Python on the same rows and machine: conversations cleaned, merged and turned into
capped reply tasks; documents redacted. The tables of $BENCH_SF_DIR are repeated $BENCH_COPIES times (new conv_ids), so that fixed costs don't decide.
Both sides read the same Parquet files, and their results are compared. Prints one JSON line."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
import time
from itertools import groupby

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from threadloom.operators import conversation, surrogates, tasks
from threadloom.session import session


def plain_tasks(folder: str) -> tuple[int, int]:
    """(tasks, sum of the lengths of their replies) in plain Python."""
    noise, signature = re.compile(conversation.SMS_NOISE), re.compile(conversation.SIGNATURE)
    table = pq.read_table(folder).to_pydict()
    rows = sorted(zip(table["conv_id"], table["turn"], table["role"], table["text"], strict=True))
    n = size = 0
    for conv, turns in groupby(rows, key=lambda r: r[0]):
        merged: list[list] = []
        for _, _, role, text in turns:
            role = {"user": "client", "assistant": "agent"}.get((role or "").strip().lower())
            text = re.sub(r"[ \t]+", " ", (text or "").replace("\r", " ").strip())
            if role is None or len(text) < 60 or noise.search(text) or signature.search(text):
                continue
            if merged and merged[-1][0] == role:
                merged[-1][1] += " " + text
            else:
                merged.append([role, text])
        asked, found = False, []
        for k, (role, text) in enumerate(merged):
            if role == "agent" and asked:
                found.append((k, text))
            asked |= role == "client"
        found = found[:1] + sorted(found[1:], key=lambda x: hashlib.md5(f"7|{conv}|{x[0]}".encode()).hexdigest())[:1]
        n += len(found)
        size += sum(len(t) for _, t in found)
    return n, size


def plain_redaction(folder: str) -> tuple[int, int]:
    """(documents, sum of the lengths of redacted texts) in plain Python."""
    rules = [(re.compile(p), c.replace("\\$", "$")) for p, c in surrogates.CONTACTS]
    n = size = 0
    for text in pq.read_table(folder)["text"].to_pylist():
        for pattern, constant in rules:
            text = pattern.sub(constant, text or "")
        n, size = n + 1, size + len(text)
    return n, size


def main() -> None:
    sf_dir, copies, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_COPIES", "100")), os.environ.get("BENCH_CPUS", "8")
    spark = session(**{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        again = spark.range(copies).withColumnRenamed("id", "copy")
        c = spark.read.parquet(f"{sf_dir}/conversations.parquet").crossJoin(again)
        c.select((F.col("conv_id") + F.col("copy") * 10_000_000).alias("conv_id"), "turn", "role", "text").repartition(int(cpus)).write.parquet(f"{folder}/conversations")
        spark.read.parquet(f"{sf_dir}/documents.parquet").crossJoin(again.limit(max(1, copies // 10))).select("text").repartition(int(cpus)).write.parquet(f"{folder}/documents")

        def spark_tasks() -> tuple[int, int]:
            role = F.when(F.col("role") == "user", "client").when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
            turns = conversation.clean_sms(spark.read.parquet(f"{folder}/conversations").withColumn("role", role)).where(F.length("text") >= 60)
            capped = tasks.head_and_sample(tasks.candidates(conversation.merge_turns(turns)), 2, 7)
            return tuple(capped.agg(F.count("*"), F.sum(F.length("gold_reply"))).first())

        def spark_redaction() -> tuple[int, int]:
            return tuple(spark.read.parquet(f"{folder}/documents").agg(F.count("*"), F.sum(F.length(surrogates.redact_contacts(F.coalesce("text", F.lit("")))))).first())

        out = {"cpus": int(cpus), "copies": copies}
        for name, by_spark, by_python, table in (("tasks", spark_tasks, plain_tasks, "conversations"), ("redaction", spark_redaction, plain_redaction, "documents")):
            took, results = {}, []
            for who, run in (("spark", by_spark), ("python", lambda f=by_python, t=table: f(f"{folder}/{t}"))):
                began = time.time()
                results.append(run())
                took[who] = round(time.time() - began, 2)
            if results[0] != results[1]:
                raise AssertionError((name, results))
            out[name] = took | {"rows": spark.read.parquet(f"{folder}/{table}").count(), "times faster": round(took["python"] / took["spark"], 1)}
        print(json.dumps(out))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        spark.stop()


if __name__ == "__main__":
    main()
