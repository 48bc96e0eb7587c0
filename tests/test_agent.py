"""Calls that are made once, the live agent, and tables that are published whole."""

import json
import os
import threading
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.operators import gate, modelcall, stores
from threadloom.operators.ledger import Ledger
from threadloom.plans import pipelines
from threadloom.streaming import agent_stream


class Counting:
    """A client that notes each call as a file, as tasks are processes of their own; breaks: bodies that end a task in mid-call, once."""

    def __init__(self, folder, breaks=(), answer=modelcall.offline_stub):
        self.folder, self.breaks, self.answer = str(folder), breaks, answer
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, model, body):
        answer = self.answer(model, body)
        for word in self.breaks:
            if word in body and not os.path.exists(f"{self.folder}/{word}.broke"):
                open(f"{self.folder}/{word}.broke", "w").close()
                raise SystemExit("the executor is gone")
        with open(f"{self.folder}/{uuid.uuid4().hex}.call", "w") as f:
            f.write(f"{model}\n{body}")
        return answer

    def calls(self):
        return Counter(open(f"{self.folder}/{x}").read() for x in os.listdir(self.folder) if x.endswith(".call"))


def requests(spark, n, model="m"):
    return modelcall.with_fingerprint(spark.createDataFrame([(str(i), f"body {i % (n - 2)} end") for i in range(n)], "id string, body string"), model)


def test_two_actions_and_a_failed_task_call_once(spark, tmp_path):
    client, ledger = Counting(tmp_path / "calls", breaks=("body 7 end",)), Ledger(str(tmp_path / "ledger"), lease=2)
    asked = requests(spark, 30)
    with pytest.raises(Exception):
        modelcall.call_misses(asked, client, ["m"], 2, ledger=ledger)
    before = client.calls()
    assert 0 < len(before) < 28
    out = modelcall.call_misses(asked, client, ["m"], 3, ledger=ledger)
    assert out.count() == 28 and out.where("parsed is null").count() == 0
    assert out.agg(F.countDistinct("fingerprint")).first()[0] == 28
    assert len(client.calls()) == 28 and set(client.calls().values()) == {1}
    assert ledger.table(spark).count() == 28
    hits, misses = modelcall.cached(asked, ledger.table(spark))
    assert hits.count() == 30 and misses.count() == 0


def test_attempts_that_run_at_one_time_call_once(tmp_path):
    ledger, made = Ledger(str(tmp_path), lease=30), []

    def call():
        made.append(1)
        time.sleep(0.2)
        return {"parsed": "{}", "metadata": "{}"}

    got = []
    runs = [threading.Thread(target=lambda: got.append(ledger.attempt().ask("ab" * 32, call))) for _ in range(6)]
    [t.start() for t in runs]
    [t.join() for t in runs]
    assert len(made) == 1 and len(got) == 6 and all(g["parsed"] == "{}" for g in got)


def test_a_lost_claim_is_taken_over_and_a_torn_line_is_no_answer(tmp_path):
    ledger, key = Ledger(str(tmp_path), lease=0.3), "cd" * 32
    os.makedirs(tmp_path / "claims")
    open(tmp_path / "claims" / key, "w").close()
    os.makedirs(tmp_path / "answers" / key[:2])
    (tmp_path / "answers" / key[:2] / "torn.jsonl").write_text(json.dumps({"fingerprint": key, "parsed": "1", "metadata": "{}"})[:-3])
    assert ledger.attempt().ask(key, lambda: {"parsed": "2", "metadata": "{}"})["parsed"] == "2"
    assert ledger.attempt().ask(key, lambda: pytest.fail("asked again"))["parsed"] == "2"
    assert not os.listdir(tmp_path / "claims")
    with pytest.raises(ValueError):
        Ledger("hdfs://somewhere/x")
    assert Ledger.of("hdfs://somewhere/x") is None


def test_failed_and_unfinished_answers_are_not_kept(spark, tmp_path):
    def client(model, body):
        if model == "a":
            return {"x": 1}, {"finish_reason": "MAX_TOKENS"}
        if "body 3 " in body:
            raise modelcall.CallError(404, "not here")
        return {"x": 2}, {"finish_reason": "STOP", "model": "b-1"}

    ledger = Ledger(str(tmp_path))
    out = {r.id: r for r in modelcall.call_misses(requests(spark, 8), client, ["a", "b"], 2, ledger=ledger).collect()}
    failed = [r for r in out.values() if r.parsed is None]
    assert len(failed) == 1 and "answer incomplete: MAX_TOKENS" in failed[0].api_error and "404" in failed[0].api_error
    assert {r.model for r in out.values() if r.parsed} == {"b-1"} and ledger.table(spark).count() == 5


def test_batched_calls_and_models_by_position(spark, tmp_path):
    client, ledger = Counting(tmp_path / "calls", answer=modelcall.offline_batch_stub), Ledger(str(tmp_path / "ledger"))
    items = spark.createDataFrame([(f"i{i:02d}", f"body {i}") for i in range(23)], "id string, body string")
    for _ in range(2):
        assert modelcall.call_batches(items, client, ["m"], 5, ledger=ledger).where("parsed is not null").count() == 23
    assert len(client.calls()) == 5 and set(client.calls().values()) == {1}
    one = Counting(tmp_path / "one")
    ordered = modelcall.by_position(spark.createDataFrame([(str(i), f"b{i}", i) for i in range(6)], "id string, body string, ord int"), 4, "first", "second")
    modelcall.call_misses(modelcall.with_fingerprint(ordered, F.col("model")), one, ["other"], 2)
    assert Counter(c.split("\n")[0] for c in one.calls()) == {"first": 4, "second": 2}


def test_retry_hints():
    assert modelcall.CallError(429, "please retry in 7.5s").wait == 7.5
    assert modelcall.CallError(429, '{"retryDelay": "31s"}').wait == 31.0
    assert modelcall.CallError(500, "no hint").wait is None


def test_outputs_are_read_by_type(spark):
    good = {"intent": "playback_app", "route": "auto_handle", "reason": "r", "draft": "d", "evidence_ids": ["a"], "reply_kind": "answer"}
    cases = [
        (good, None), (good | {"evidence_ids": [], "more": {"x": 1}}, None), ([good], "Incomplete agent JSON"), ("text", "Incomplete agent JSON"), ({k: v for k, v in good.items() if k != "reason"}, "Incomplete agent JSON"),
        (good | {"intent": "weather"}, "Invalid labels"), (good | {"route": None}, "Invalid labels"), (good | {"route": 1}, "Invalid labels"), (good | {"reply_kind": "advice"}, "Invalid reply kind"), (good | {"draft": 7}, "Invalid text"),
        (good | {"reason": None}, "Invalid text"), (good | {"draft": ["d"]}, "Invalid text"), (good | {"evidence_ids": "a"}, "Invalid evidence IDs"), (good | {"evidence_ids": [1]}, "Invalid evidence IDs"), (good | {"evidence_ids": ["a", None]}, "Invalid evidence IDs"),
        (good | {"evidence_ids": None}, "Invalid evidence IDs"), (good | {"evidence_ids": {"a": 1}}, "Invalid evidence IDs"),
    ]
    texts = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(90, None), (91, "{"), (92, "")]
    got = {r.i: r.o for r in spark.createDataFrame(texts, "i int, t string").select("i", gate.read_output(F.col("t")).alias("o")).collect()}
    for i, (case, error) in enumerate(cases):
        assert got[i].error == error and (got[i].output is None) == (error is not None), case
    assert got[0].output.evidence_ids == ["a"] and got[0].output.draft == "d"
    assert all(got[i].error == "Incomplete agent JSON" for i in (90, 91, 92))


HISTORY = [(1, "the music stops on my phone", "Which device is it, and which app version?"), (2, "please add folders", "A fine suggestion"), (3, "the lists are gone", "Which device is it?")]


def cites(model, body):
    return modelcall.offline_citing_stub(model, body)


def test_a_stream_that_is_started_again_gives_each_row_once(spark, tmp_path):
    precedents = pipelines.Precedents.of(spark.createDataFrame(HISTORY, "id long, message string, reply string"))
    words = ["the music stops", "add folders please", "my lists are gone", "nothing known here", None, "I was charged twice"]
    (tmp_path / "in").mkdir()
    rows = [{"id": f"{f}-{i}", "message": w and f"{w} {f}", "context": ["hello"], "context_flagged": False} for f in range(4) for i, w in enumerate(words)]
    for f in range(4):
        (tmp_path / "in" / f"{f}.json").write_text("\n".join(json.dumps(r) for r in rows[6 * f : 6 * f + 6]))
        time.sleep(0.01)
    client, ledger = Counting(tmp_path / "calls", breaks=("add folders please 2",), answer=cites), Ledger(str(tmp_path / "ledger"), lease=2)
    start = lambda: agent_stream.live_agent(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), precedents, ledger, files=1, client=client, models="m")
    with pytest.raises(Exception):
        start()
    done = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < done < 24
    start()
    start()  # nothing new has come
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    messages = spark.createDataFrame([tuple(r.values()) for r in rows], agent_stream.MESSAGES)
    want = pipelines.answered(messages, precedents, client=cites, models="m").collect()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want) == 24
    for w in want:
        assert all(got[w.id][c] == w[c] for c in ("route", "draft", "reason", "evidence_ids", "api_error", "model")), w.id
    assert {r.route for r in want} == {"auto_handle", "escalate"}
    assert set(client.calls().values()) == {1}


def test_a_batch_that_stands_is_not_written_again(spark, tmp_path):
    out = str(tmp_path / "out")
    assert agent_stream.commit_batch(spark.range(3), out, 0) and not agent_stream.commit_batch(spark.range(9), out, 0)
    assert spark.read.parquet(out).count() == 3


def test_readers_of_snapshots_see_no_gap(spark, tmp_path):
    table = stores.Snapshots(spark, str(tmp_path / "t"))
    assert table.latest() == 0 and table.publish(spark.range(1)) == 1
    pinned, seen, stop = table.read(), [], threading.Event()

    def reader():
        while not stop.is_set():
            v = table.latest()
            seen.append((v, table.read(v).count()))

    reading = threading.Thread(target=reader)
    reading.start()
    for n in range(2, 21):
        assert table.publish(spark.range(n), after=n - 1) == n
    stop.set()
    reading.join()
    assert seen and all(v == n for v, n in seen)
    assert pinned.count() == 1 and table.read().count() == 20 and table.versions() == list(range(1, 21))


def test_writers_with_the_same_number_are_told_apart(spark, tmp_path):
    a, b = (stores.Snapshots(spark, str(tmp_path / "t")) for _ in range(2))
    a.publish(spark.range(1))
    seen = b.latest()
    a.publish(spark.range(2), after=seen)
    with pytest.raises(stores.Conflict):
        b.publish(spark.range(3), after=seen)
    assert b.read().count() == 2 and b.versions() == [1, 2]
    assert b.restore(1) == 3 and a.read().count() == 1 and a.read(2).count() == 2
    a.publish(spark.range(4).withColumn("x", F.lit(None).cast("string")))
    assert a.read().columns == ["id", "x"]
    (tmp_path / "t" / "data" / "left").mkdir()
    a.vacuum(keep=2)
    assert a.versions() == [3, 4] and len(os.listdir(tmp_path / "t" / "data")) == 2 and a.read(3).count() == 1
    with pytest.raises(ValueError):
        a.vacuum(0)
