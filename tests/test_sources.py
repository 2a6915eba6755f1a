"""Readers, adapters, connectors and streams from small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from verdigrade.sources import datasets as ds
from verdigrade.sources import providers as pv
from verdigrade.sources import schemas
from verdigrade.streaming import monitor


def test_pack(spark, tmp_path):
    (tmp_path / "manifest.yaml").write_text("name: n\nversion: '1'\nsplit: test\nlicense: MIT\npii_scrubbed: true\ncreated_at: 2025-01-01\nslices: [d]\n")
    (tmp_path / "cases.jsonl").write_text('{"id": "a", "task_type": "qa_short", "inputs": {"question": "q"}, "qrels": {"d": 2}}\n\n  {"id": "b"}  \n')
    manifest, cases = ds.read_pack(spark, str(tmp_path))
    assert manifest["name"] == "n" and {r.id: r.qrels for r in cases.collect()} == {"a": {"d": 2}, "b": None}
    import hashlib

    lines = [x.strip() for x in (tmp_path / "cases.jsonl").read_text().splitlines() if x.strip()]
    assert ds.content_sha256(spark, str(tmp_path / "cases.jsonl")) == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    ds.register(spark)
    assert spark.read.format("verdigrade_pack").load(str(tmp_path)).count() == 2
    (tmp_path / "cases.jsonl").write_text('{"id": "a", "weight": "heavy"}\n')
    with pytest.raises(Exception):
        ds.read_pack(spark, str(tmp_path))[1].collect()
    (tmp_path / "manifest.yaml").write_text("name: n\n")
    with pytest.raises(ValueError):
        ds.read_manifest(str(tmp_path))


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_adapters(spark, tmp_path):
    squad = {"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q?", "answers": [{"text": "a", "answer_start": 0}, {"text": "b", "answer_start": 2}]}, {"id": "2", "question": "r?", "answers": []}]}]}]}
    rows = ds.squad(spark, write(tmp_path, "s.json", json.dumps(squad))).collect()
    assert [(r.id, r.reference_answer, r.references, r.inputs["question"]) for r in rows] == [("1", "a", ["a", "b"], "q?")]
    news = ds.ag_news(spark, write(tmp_path, "n.csv", '3,"A ""big"" deal","Text, more"\n1,x,y\n')).orderBy("id").collect()
    assert [(r.id, r.expected_label) for r in news] == [("ag-0", "Business"), ("ag-1", "World")] and news[0].inputs["text"] == 'A "big" deal Text, more'
    with pytest.raises(Exception, match="label from 1 to 4"):
        ds.ag_news(spark, write(tmp_path, "m.csv", "9,x,y\n")).collect()
    pub = ds.pubmedqa(spark, write(tmp_path, "p.json", json.dumps({"7": {"QUESTION": "q", "CONTEXTS": ["a", "b"], "final_decision": "yes"}, "8": {"QUESTION": "r", "CONTEXT": "c", "final_decision": "no"}}))).collect()
    assert {r.id: (r.inputs["context"], r.expected_label) for r in pub} == {"7": ("a\nb", "yes"), "8": ("c", "no")}
    pb = ds.phrasebank(spark, write(tmp_path, "b.txt", "mail me @ noon@positive\n\n")).collect()
    assert [(r.inputs["text"], r.expected_label) for r in pb] == [("mail me @ noon", "positive")]
    fin = ds.finqa(spark, write(tmp_path, "f.json", json.dumps([{"id": "z", "pre_text": ["a"], "post_text": ["b"], "qa": {"question": "q", "answer": "5"}}]))).collect()
    assert fin[0].inputs["context"] == "a\nb" and fin[0].reference_answer == "5"
    summ = ds.summaries(spark, write(tmp_path, "u.jsonl", '{"id":"1","article":"x","highlights":"y"}\n')).collect()
    assert summ[0].inputs["document"] == "x" and summ[0].reference_answer == "y"
    assert all(a.read and a.metrics for a in ds.ADAPTERS.values()) and len(ds.ADAPTERS) == 9
    cases = spark.createDataFrame([("a", {"q": "x" * 2001}, None), ("b", {"q": "x"}, "y" * 501), ("c", {"q": None}, "y")], "id string, inputs map<string,string>, reference_answer string").withColumns({"expected_label": F.lit(None).cast("string"), "references": F.lit(None).cast("array<string>")})
    assert [r.id for r in ds.within_bounds(cases).collect()] == ["c"]


def test_schemas():
    assert schemas.CASE["qrels"].dataType.simpleString() == "map<string,int>" and schemas.GENERATION["cost_usd"].dataType.simpleString() == "decimal(12,6)"


def test_mock(spark):
    df = spark.createDataFrame([("What is 41 plus one?",), ("Who?",), (None,)], "p string")
    assert [r.output for r in pv.mock_answers(df, "p").collect()] == ["42", "unknown", "unknown"]


def test_streamed_answers():
    sse = [b"", b'data: {"choices":[{"delta":{"content":"Hel"}}]}', b'data: {"choices":[{"delta":{"content":"lo","tool_calls":[{"index":0,"function":{"name":"f","arguments":"{"}}]},"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"completion_tokens":2}}', b'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"}"}}]}}]}', b"data: [DONE]", b"data: junk"]
    r = pv.read_stream(iter(sse), "chat_events")
    assert (r["output"], r["finish_reason"], r["prompt_tokens"], r["tool_calls"]) == ("Hello", "stop", 3, [{"name": "f", "arguments": "{}"}])
    nd = [b'{"message":{"content":"a"}}', b'{"message":{"content":"b"},"done":true,"done_reason":"length","eval_count":2}']
    assert pv.read_stream(iter(nd), "chat_lines") | {} == {"output": "ab", "finish_reason": "length", "prompt_tokens": None, "completion_tokens": 2, "tool_calls": []}


def test_limits():
    now = [0.0]
    b = pv.TokenBucket(60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert b.take(60) == 0.0 and b.take(1) == pytest.approx(1.0)
    c = pv.CircuitBreaker(2, 10, clock=lambda: now[0])
    c.record(False), c.record(False)
    assert c.state == "open" and not c.allow()
    now[0] += 10
    assert c.state == "half_open" and c.allow() and not c.allow()
    c.record(True)
    assert c.state == "closed"
    assert pv.backoff(3, retry_after=9.0, rng=random.Random(1)) == 9.0 and pv.backoff(20, cap=2.0) <= 2.0


def test_generate(spark):
    def call(endpoint, prompt):
        if prompt == "bad":
            raise TimeoutError
        return {"output": f"{prompt}!", "finish_reason": "length" if prompt == "long" else "stop", "prompt_tokens": 1, "completion_tokens": 1}

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "long")], "i int, prompt string").coalesce(1)
    got = {r.i: (r.output, r.outcome, r.attempts) for r in pv.generate(df, "prompt", pv.Endpoint("http://x", "m", attempts=2), call).collect()}
    assert got == {1: ("a!", "passed", 1), 2: (None, "harness_timeout", 2), 3: ("long!", "truncated", 1)}


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = spark.range(200).select(F.col("id").alias("event_id"), (F.timestamp_seconds(1735689600 + F.col("id") * 400)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("click").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))
    base.where("event_id < 120").coalesce(1).write.parquet(src)
    for _ in range(2):
        monitor.update_into(monitor.tumbling_counts(monitor.event_stream(spark, src), "1 hour", None), f"{out}/agg", f"{out}/c1")
        monitor.ingest_once(monitor.event_stream(spark, src), f"{out}/rows", f"{out}/c2", ["event_id"])
        base.where("event_id >= 100").coalesce(1).write.mode("append").parquet(src)
    assert spark.read.parquet(f"{out}/rows").count() == 200
    last = spark.read.parquet(f"{out}/agg/batch=*").groupBy("start").agg(F.max_by("n", "_batch").alias("n"))
    seen = base.where("event_id < 120").unionByName(base.where("event_id >= 100")).withColumn("ts", F.col("ts").cast("timestamp"))
    want = monitor.tumbling_counts(seen, "1 hour").select("start", "n")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_answers_are_kept_for_later_runs(spark, tmp_path):
    from verdigrade import pipeline

    log = str(tmp_path / "calls")

    def call(endpoint, prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return {"output": "A" + prompt, "finish_reason": "stop"}

    cases = spark.createDataFrame([("1", {"q": "x"}), ("2", {"q": "y"})], "id string, inputs map<string,string>")
    cold, warm = pv.Endpoint("http://x", "m"), pv.Endpoint("http://x", "m", params={"temperature": 0.7})
    store, n = str(tmp_path / "s"), lambda: sum(1 for _ in open(log))
    pipeline.run(spark, store, cases, "{{ q }}", 1, cold, run_id="a", partitions=1, call=call, cached=True)
    assert n() == 2
    pipeline.run(spark, store, cases, "{{ q }}", 1, cold, run_id="b", partitions=1, call=call, cached=True)
    assert n() == 2
    pipeline.run(spark, store, cases, "{{ q }}", 1, warm, run_id="c", partitions=1, call=call, cached=True)
    assert n() == 4
    rows = spark.read.parquet(f"{store}/generations").groupBy("run_id").agg({"output": "min", "attempts": "sum"}).collect()
    assert {r.run_id: (r["min(output)"], r["sum(attempts)"]) for r in rows} == {"a": ("Ax", 2), "b": ("Ax", 0), "c": ("Ax", 2)}


def test_refusals_of_a_server_are_final_and_waits_are_heeded(monkeypatch):
    import urllib.error

    waits, asked = [], []
    monkeypatch.setattr(pv.time, "sleep", waits.append)

    def answer(code, headers):
        def call(endpoint, prompt):
            asked.append(code)
            raise urllib.error.HTTPError("u", code, "no", headers, None)

        return call

    e = pv.Endpoint("u", "m")
    for code, headers, tries, slept in ((400, {}, 1, []), (429, {"Retry-After": "7"}, 3, [7.0, 7.0]), (503, {"Retry-After": "soon"}, 3, None)):
        waits.clear(), asked.clear()
        got = pv._attempts(e, "p", pv.TokenBucket(600), pv.CircuitBreaker(), answer(code, headers))
        assert got["outcome"] == "harness_error" and len(asked) == tries and (slept is None or waits == slept)
