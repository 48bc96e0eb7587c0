"""Sources, sinks, the stream, the registry's contract."""

import csv
import io
import json
import random
import zipfile

import pytest

from threadloom.plans import fixtures as X
from threadloom.plans import pipelines, registry
from threadloom.sources import archive
from threadloom.streaming import gate_stream

CSV = '''tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
1,u1,True,Tue Oct 31 22:10:47 +0000 2017,"Help, ""please""
now","2, 9",
2,Brand,False,Tue Oct 31 22:11:47 +0000 2017,Which device is it?,,1
3,u2,True,Tue Oct 31 22:12:47 +0000 2017,Where are my lists kept these days,4,
4,Brand,False,Tue Oct 31 22:13:47 +0000 2017,Look in the menu,,3
5,u3,True,Tue Oct 31 22:12:47 +0000 2017,Another brand altogether here,6,
6,Other,False,Tue Oct 31 22:13:47 +0000 2017,Hello,,5
'''


def test_zipped_archive_and_split_builder(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("twcs/twcs.csv", CSV)
    path = archive.unzip_once(str(tmp_path / "a.zip"), str(tmp_path / "staging"))
    rows = archive.stage(archive.read_archive(spark, path), str(tmp_path / "rows"))
    first = rows.where("tweet_id = 1").first()
    assert first.text == 'Help, "please"\nnow' and first.response_ids == [2, 9] and first.parent_id is None and first.inbound
    assert str(first.created_at) == "2017-10-31 22:10:47"
    with pytest.raises(Exception):
        archive.stage(rows, str(tmp_path / "rows"))
    splits = pipelines.build_splits(rows, "Brand", {"dev": 1}, {})
    assert splits.examples.count() == 1 and splits.examples.where("component_id = 5").count() == 0
    used, history = {r.component_id for r in splits.examples.collect()}, {r.customer_id for r in splits.history.collect()}
    assert not used & history and history <= {1, 3}
    with pytest.raises(ValueError):
        archive.unzip_once(str(tmp_path / "a.zip"), str(tmp_path / "s2"), "other.csv")


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000, 1 << 20])
def test_a_zipped_csv_is_cut_where_its_records_end(spark, tmp_path, monkeypatch, chunk):
    """Whatever the pieces: quotes, line breaks and characters of several bytes over their borders; groups of three pieces in the scans."""
    monkeypatch.setattr(archive, "GROUP", 3)
    draw = random.Random(5)
    words = ["plain", 'a "quoted" word', "two\nlines", "é 日本 😀", "", ",", '"', "\r\n", "x" * 30]
    n = 12 if chunk < 7 else 60
    rows = [[str(i), draw.choice(words), "True", "", "".join(draw.choice(words) for _ in range(draw.randrange(4))), f"{i + 1}, {i + 2}" if i % 3 else "", str(i - 1) if i % 2 else ""] for i in range(n)]
    for end, last in (("\n", True), ("\r\n", False)):
        text = io.StringIO()
        writer = csv.writer(text, lineterminator=end)
        writer.writerows([archive.COLUMNS, *rows])
        told = text.getvalue() if last else text.getvalue().removesuffix(end)
        path = tmp_path / f"{len(end)}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("folder/twcs.csv", b"\xef\xbb\xbf" + told.encode())
            z.writestr("other.csv", "a,b")
        got = archive.quoted_csv(archive.zip_member(spark, str(path), "twcs.csv", chunk), archive.COLUMNS).collect()
        want = [tuple(r[c] for c in archive.COLUMNS) for r in csv.DictReader(io.StringIO(told, newline=""))]
        assert sorted(map(tuple, got)) == sorted(want) and len(got) == n
    typed = archive.read_zip(spark, str(path), chunk=max(chunk, 64))
    assert typed.where("parent_id is not null").count() == n // 2 and typed.schema["response_ids"].dataType.simpleString() == "array<bigint>"
    with pytest.raises(Exception, match="holds 0 files"):
        archive.zip_member(spark, str(path), "absent.csv")


def test_keyed_json_and_sinks(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"ratings": {"a": {"correctness": 2, "notes": "x"}, "b": {"correctness": "", "notes": ""}}}))
    got = archive.read_keyed(spark, str(tmp_path / "d.json"), "ratings", "correctness: string, notes: string", "rating_id")
    assert {r.rating_id: r.correctness for r in got.collect()} == {"a": "2", "b": ""}
    assert archive.markdown(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string")) == "| a | b | c |\n|---|---|---|\n| 1 | 0.500 | – |\n"
    with pytest.raises(ValueError):
        archive.markdown(spark.range(12), most=11)
    assert archive.markdown(spark.range(12), most=12).count("\n") == 14
    with pytest.raises(ValueError):
        archive.write_json(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "out"))
    sheet = archive.worksheet(spark.createDataFrame([("7", "hello")], "tweet_id string, message string"), ["7", "8"])
    assert "1. 7\n\nhello" in sheet and "(absent)" in sheet


def test_stream_gates_like_a_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    names = ("id", "intent", "route", "reason", "draft", "evidence_ids", "reply_kind", "allowed_ids")
    messages = {m[0]: m for m in X.MESSAGES}
    with open(tmp_path / "in" / "a.json", "w") as f:
        for row in X.OUTPUTS:
            f.write(json.dumps(dict(zip(names, row)) | {"message": messages[row[0]][1], "context_flagged": messages[row[0]][3]}) + "\n")
    gate_stream.run_available(gate_stream.gated_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.id: (r.route, r.draft, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id: (r.route, r.draft, r.reason) for r in gate_stream.gate(spark.read.schema(gate_stream.SCHEMA).json(str(tmp_path / "in"))).collect()}
    assert got == want and len(got) == len(X.OUTPUTS)


def test_registry_names():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.ORACLE_SQL) >= 50
