"""The label store's log against a replay in plain Python, and replays of the gate under two versions."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import rules as R
from threadloom.operators import gate, stores, threads
from threadloom.schemas import INTENTS, REASONS, ROUTES

ROW = stores.LabelStore.ROW


def store(spark, path, packet_id="p1", guide="g1"):
    return stores.LabelStore(spark, str(path), spark.createDataFrame([(f"t{i}",) for i in range(6)], "tweet_id string"), packet_id, guide)


def label(draw, at):
    return (f"t{draw.randrange(6)}", draw.choice(INTENTS), draw.choice(ROUTES), draw.choice(("", *REASONS)), "", "n", f"2026-01-01T00:00:{at:02d}")


def told(df):
    return {r.tweet_id: tuple(r) for r in df.select(*(c.split()[0] for c in ROW.split(", "))).collect()}


def test_any_earlier_event_can_be_gone_back_to(spark, tmp_path):
    """States are those of a replay of the log: updates, restorations and compactions in any order."""
    draw, kept, own = random.Random(4), {0: {}}, store(spark, tmp_path / "s")
    now: dict[str, tuple] = {}
    for seq in range(1, 12):
        kind = "update" if seq < 4 else draw.choice(["update", "update", "restore", "compact"])
        if kind == "update":
            rows = [label(draw, seq * 2 + k) for k in range(2)]
            assert own.update(spark.createDataFrame(rows, ROW)) == seq
            now = dict(now)
            for r in rows:
                now[r[0]] = r
        elif kind == "restore":
            back = draw.randrange(seq)
            assert own.restore(back) == seq
            now = kept[back]
        else:
            assert own.compact() == seq
        kept[seq] = now
    assert told(own.state()) == now
    for seq, want in kept.items():
        assert told(own.state(seq)) == want, seq
    assert told(store(spark, tmp_path / "s").state()) == now  # opened by its path


def test_labels_are_checked_and_exports_are_for_their_packet(spark, tmp_path):
    own = store(spark, tmp_path / "s")
    for bad in (("t9", INTENTS[0], ROUTES[0]), ("t1", "weather", ROUTES[0]), ("t1", INTENTS[0], "nowhere"), (None, INTENTS[0], ROUTES[0])):
        with pytest.raises(ValueError):
            own.update(spark.createDataFrame([("t0", INTENTS[0], ROUTES[0]), bad], "tweet_id string, intent string, route string"))
    assert own.log() == [] and own.state().count() == 0 and not own.complete()
    own.update(spark.createDataFrame([(f"t{i}", INTENTS[1], ROUTES[0]) for i in range(6)], "tweet_id string, intent string, route string"))
    assert own.complete()
    own.export(str(tmp_path / "out"))
    own.update(spark.createDataFrame([("t0", "", "")], "tweet_id string, intent string, route string"))
    assert not own.complete()
    assert own.load(str(tmp_path / "out")) == 3 and own.complete()
    for other in (store(spark, tmp_path / "s2", packet_id="p2"), store(spark, tmp_path / "s3", guide="g2")):
        with pytest.raises(ValueError):
            other.load(str(tmp_path / "out"))
    with pytest.raises(ValueError):
        own.restore(77)


COLUMNS = "id int, message string, raw string, allowed_ids array<string>, context_flagged boolean"


def test_two_versions_of_the_check_over_raw_outputs(spark):
    out = lambda draft, kind="answer": '{"intent": "playback_app", "route": "auto_handle", "reason": "r", "draft": "%s", "evidence_ids": ["a"], "reply_kind": "%s"}' % (draft, kind)
    rows = [(1, "It stops", out("Which device is it?"), ["a"], False), (2, "It stops", out("We will keep an eye on it"), ["a"], False), (3, "It stops", out("x" * 60), ["a"], False), (4, "It is gone already", out("Which device?"), ["a"], False), (5, "It stops", "{broken", ["a"], False)]
    raw = spark.createDataFrame(rows, COLUMNS)
    old = R.RuleSet("v3", tuple(a for a in R.ACTIONS if a != "promises"), check_risk=False)
    new = R.RuleSet("v4", most_chars=50, copy=dict.fromkeys(R.HANDOFF_COPY, "Somebody reads it."))
    every = gate.replayed(raw, [old, new]).collect()
    assert len(every) == 10 and {(r.id, r.api_error) for r in every if r.api_error} == {(5, "Incomplete agent JSON")}
    got = {r.id: r for r in gate.version_diff(raw, old, new, "id").collect()}
    assert set(got) == {2, 3, 4, 5}
    assert got[2].gained == [R.VIOLATION_TEXT["action"]] and got[3].gained == [R.VIOLATION_TEXT["size"]] and got[4].gained == [R.REASON_TEXT["repeat"]]
    assert got[2].old_route == "auto_handle" and got[2].new_route == "escalate" and got[2].new_draft == "Somebody reads it."
    assert got[5].gained == [] and got[5].old_route == got[5].new_route == "escalate"  # only its copy is another
    back = {r.id: r for r in gate.version_diff(raw, new, old, "id").collect()}
    assert back[2].lost == [R.VIOLATION_TEXT["action"]]
    assert R.RuleSet(actions=()).pattern == "(?!)"
    assert spark.range(1).select(R.has_unsupported_action(F.lit("see http://x"), R.RuleSet(actions=()).pattern).alias("x")).first().x is False


def test_packet_ids_follow_rows_and_not_partitions(spark):
    rows = spark.range(40).select("id", F.concat(F.lit("t"), "id").alias("text"))
    one = stores.packet_id(rows.repartition(5), "id")
    assert one == stores.packet_id(rows.orderBy(F.desc("id")).select("text", "id"), "id")
    assert one != stores.packet_id(rows.where("id < 39"), "id") != stores.packet_id(rows.withColumn("text", F.lower("text")).where("id < 38"), "id")
    with pytest.raises(ValueError):
        stores.packet_id(rows, "id", most=39)


def test_ratings_meet_their_key(spark):
    items, key = threads.blinded_packet(spark.createDataFrame([(1, "m"), (2, "n")], "id int, message string"), spark.createDataFrame([("a",), ("b",)], "system string"), "s")
    assert items.columns == ["message", "rating_id"]
    rated = key.select("rating_id", F.lit(2).alias("score")).limit(3)
    assert threads.unblinded(rated, key).count() == 3 and set(threads.unblinded(rated, key).columns) == {"rating_id", "score", "system", "id"}
    for bad in (rated.union(rated.limit(1)), spark.createDataFrame([("none", 1)], "rating_id string, score int")):
        with pytest.raises(ValueError):
            threads.unblinded(bad, key)
