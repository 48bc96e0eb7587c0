"""Rules, text functions and the gate, on messages of our own."""

from pyspark.sql import functions as F

from threadloom.functions import rules as R
from threadloom.functions import text as T
from threadloom.operators import gate as G
from threadloom.plans import fixtures as X


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_sentiment_labels(spark):
    want = {"Thank you, I love it 😊": "positive", "This is broken and frustrating": "negative", "Thanks, but it is broken": "mixed", "I want to kill myself": "distressed", "I finally have access": "positive", "How do I sort it?": "neutral"}
    rows = spark.createDataFrame([(k,) for k in want], "x string").select("x", R.sentiment(F.col("x")).alias("s")).collect()
    assert {r.x: r.s.label for r in rows} == want


def test_heart_counts_for_both_of_its_spellings(spark):
    assert one(spark, "❤️", lambda x: R.sentiment(x)["positive_hits"]) == 2


def test_distress_is_high_and_minus_one(spark):
    s = one(spark, "self-harm", R.sentiment)
    assert (s.score, s.intensity, s.positive_hits, s.negative_hits) == (-1.0, "high", 0, 1)


def test_negative_wording_alone_is_no_risk(spark):
    assert one(spark, "This design is awful", lambda x: R.risk_reason(x, F.lit("feedback_feature_request"), F.lit(False))) is None


def test_polish(spark):
    assert one(spark, "@user We can check this out backstage!! /TB", T.polish) == "We can take a closer look privately!"
    assert one(spark, "plain", T.was_polished) is False


def test_claims_are_seen(spark):
    for text in ("We've received it and sent a DM back.", "We'll pass this to the relevant team.", "We'll make it available soon", "We'll keep an eye out for it.", "We hope to have this album soon."):
        assert one(spark, text, lambda x: R.has_unsupported_action(F.lower(x)))


def test_redaction_order_and_archive_time(spark):
    assert one(spark, "a.b@c.org 1234 5678 9012 @me", T.privacy_redact) == "[email redacted] [number redacted] [user]"
    assert str(one(spark, "Tue Oct 31 22:10:47 +0000 2017", T.archive_time)) == "2017-10-31 22:10:47"
    assert one(spark, "not a time", T.archive_time) is None


def test_input_text_takes_the_last_four_and_the_message_twice(spark):
    row = spark.createDataFrame([(["a", "b", "c", "d", "e"], "m"), ([], "n"), (["a"], "o")], "c array<string>, m string")
    assert [r.y for r in row.select(T.input_text(F.col("c"), F.col("m")).alias("y")).collect()] == ["b c d e m m", "n n", "a o o"]


def test_gate_stops_unknown_citations_and_claims(spark):
    row = ("Thank you", "social_acknowledgement", "auto_handle", "fine", "We've issued a refund.", ["fake"], "answer", [], False)
    columns = "message string, intent string, route string, reason string, draft string, evidence_ids array<string>, reply_kind string, allowed_ids array<string>, context_flagged boolean"
    out = G.gate(spark.createDataFrame([row], columns)).first()
    assert out.route == "escalate" and len(out.output_check_violations) == 2 and "issued" not in out.draft and out.evidence_ids == [] and out.reply_kind == "handoff"


def test_gate_never_lets_a_violation_out(spark):
    rows = X.rows(spark, X.OUTPUTS, X.OUTPUT_COLUMNS).join(X.rows(spark, X.MESSAGES, X.MESSAGE_COLUMNS).selectExpr("id", "message", "flagged as context_flagged"), "id")
    out = G.gate(rows)
    assert out.where("size(output_check_violations) > 0 and (route <> 'escalate' or size(evidence_ids) > 0)").count() == 0
    assert out.where("route = 'auto_handle' and size(evidence_ids) = 0").count() == 0


def test_guarded_reply(spark):
    columns = "message string, intent string, context_flagged boolean, evidence array<struct<id:string,reply:string,similarity:double>>"
    rows = [
        ("It stops", "playback_app", False, [("a", "hello", 0.5), ("b", "Which device is it?", 0.4)]), ("It stops", "playback_app", False, [("b", "Which device is it?", 0.2)]),
        ("my password", "playback_app", False, [("b", "Which device is it?", 0.9)]), ("It stops", "playback_app", False, []),
    ]
    out = G.guarded_reply(spark.createDataFrame(rows, columns)).collect()
    assert [(r.route, r.evidence_ids) for r in out] == [("auto_handle", ["b"]), ("escalate", []), ("escalate", []), ("escalate", [])]


def test_character_references_are_pythons(spark):
    import html

    odd = [None, "", "&", "a & b", "&amp;lt;", "&lt;b&gt;", "&notit;", "&notin;", "&copy2024", "&AMP", "&ampx;", "&unknown;", "&#65;&#x41;&#X41", "&#0;", "&#x0D;", "&#128;&#x9f;&#x81;", "&#xD800;", "&#x110000;", "&#99999999999999999999;"]
    odd += ["&#1;", "&#xFDD0;", "&#x1FFFF;", "&#;", "&#x;", "&hellip;…&nbsp;|", "&NotEqualTilde;", "&ngE;", "&;", "&&amp;&", "x&#128512;y", "&CounterClockwiseContourIntegral;", "&lt" * 3, "&" + "a" * 40 + ";", "&#000065;", "tab&Tab;&NewLine;"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, x string").select("i", T.unescape(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in rows} == {i: x if x is None else html.unescape(x) for i, x in enumerate(odd)}


def test_every_named_reference(spark):
    from html import unescape
    from html.entities import html5

    rows = spark.createDataFrame([(f"&{k}",) for k in sorted(html5)], "x string").select("x", T.unescape(F.col("x")).alias("y")).collect()
    assert len(rows) == len(html5) and all(r.y == unescape(r.x) for r in rows)


def test_copy_holds_its_phrases():
    assert set(R.COPY_PHRASES) <= set(R.HANDOFF_COPY)
    for key, phrases in R.COPY_PHRASES.items():
        assert all(p.casefold() in R.HANDOFF_COPY[key].casefold() for p in phrases), key
    assert not any(w in R.HANDOFF_COPY[k] for k in ("feature", "feature_waited", "playback", "resolved", "unclear", "catalog_title") for w in ("DMs", "account details", "payment"))


def test_full_decoding_leaves_open_what_its_sql_leaves_open(spark, tmp_path):
    """A title that was cut within a reference (`&amp`) has no semicolon; the SQL decodes closed references only."""
    import duckdb

    from threadloom.plans import text_queries as Q

    odd = ["and&amp</title>", "&am", "&", "&amp;amp;", "&amp&lt;", "&amp;lt", "&ampx;", "&#39;&#39", "&nbsp;&quot;&quot", None, "", "&hellip;&middot;&copy&copy;"]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").write.parquet(path)
    got = {r.page_id: r.html for r in Q.html_unescape_full(spark, str(tmp_path)).collect()}
    assert got == dict(duckdb.sql(Q.ORACLE_SQL["html_unescape_full"].replace("FROM pages", f"FROM '{path}/*.parquet'")).fetchall())
    closed = {r.x: r.y for r in spark.createDataFrame([("&Zeta;&#65;&#x42;&Zeta&#65&eacute",)], "x string").select("x", T.unescape(F.col("x"), closed=True).alias("y")).collect()}
    assert closed == {"&Zeta;&#65;&#x42;&Zeta&#65&eacute": "ΖAB&Zeta&#65&eacute"}
