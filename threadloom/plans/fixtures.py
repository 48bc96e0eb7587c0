"""Our own messages for rules that the tables' invented prose never meets; as rows and as SQL VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (id, message, intent, flagged, has_parent)
MESSAGES = [
    (1, "Thank you, I love the new look 😊", "social_acknowledgement", False, False),
    (2, "The app is broken and it is so frustrating", "playback_app", False, False),
    (3, "Thanks, but playback is broken", "playback_app", False, True),
    (4, "I want to end my life", "other_unclear", False, False),
    (5, "I finally have access", "other_unclear", False, False),
    (6, "How do I sort a long list?", "library_playlists", False, False),
    (7, "Someone has stolen my login", "account_access_security", False, False),
    (8, "I was charged twice this month!!!", "billing_subscription", False, False),
    (9, "Where can I see my plan", "billing_subscription", False, False),
    (10, "Does it play on the car radio", "playback_app", True, True),
    (11, "hm", "other_unclear", False, True),
    (12, "I tried that and it does not work", "playback_app", False, True),
    (13, "bump", "feedback_feature_request", False, True),
    (14, "не работает", "playback_app", False, False),
    (15, "This design is awful", "feedback_feature_request", False, False),
    (16, "WORST update, it STOPPED &amp; sucks 😡😡", "playback_app", False, False),
    (17, "Been waiting years for lyrics ❤️", "feedback_feature_request", False, False),
    (18, "When will that album come back", "catalog_availability", False, False),
    (19, "", "other_unclear", False, False),
    (20, "again and again the same error", "playback_app", None, None),
    (21, "Please add folders https://example.com/x @support", "feedback_feature_request", False, False),
    (22, "Any update on my lists", "library_playlists", False, True),
    (23, None, "playback_app", False, False),
    (24, "How do I sort it", "library_playlists", False, False),
    (25, "How do I hide it", "library_playlists", False, False),
    (26, "How do I share it", "library_playlists", False, False),
    (27, "How do I rename it", "library_playlists", False, False),
    (28, "How do I copy it", "library_playlists", False, False),
    (29, "How do I print it", "library_playlists", False, False),
    (30, "How do I move it", "library_playlists", False, False),
    (31, "How do I merge it", "library_playlists", False, False),
    (32, "How do I lock it", "library_playlists", False, False),
]
MESSAGE_COLUMNS = "id int, message string, intent string, flagged boolean, has_parent boolean"

# (id, intent, route, reason, draft, evidence_ids, reply_kind, allowed_ids): outputs that must pass or be stopped
OUTPUTS = [
    (1, "social_acknowledgement", "auto_handle", "fine", "You are welcome!!", ["a"], "acknowledgement", ["a", "b"]),
    (2, "playback_app", "auto_handle", "fine", "Which device is it? /TB", ["zz"], "clarification", ["a"]),
    (3, "playback_app", "auto_handle", "fine", "We've issued a refund.", [], "answer", ["a"]),
    (4, "other_unclear", "escalate", "unsafe", "This needs a human.", [], "handoff", []),
    (5, "other_unclear", "escalate", "unclear scope", "@user: we can check this out backstage", [], "handoff", []),
    (6, "library_playlists", "auto_handle", "fine", "See https://example.com/help", ["b"], "answer", ["b"]),
    (7, "account_access_security", "auto_handle", "fine", "Please reset it.", ["a"], "answer", ["a"]),
    (8, "billing_subscription", "escalate", "payment", "  ", [], "handoff", ["a"]),
    (9, "billing_subscription", "auto_handle", "fine", "We will keep an eye on it", ["a"], "answer", ["a"]),
    (10, "playback_app", "auto_handle", "fine", "Which   version is it?", ["a"], "clarification", ["a"]),
    (11, "other_unclear", "auto_handle", "fine", "Tell us more", ["a"], "clarification", ["a"]),
    (12, "playback_app", "escalate", "Prior attempts", "We'll pass this to the team.", [], "handoff", []),
    (13, "feedback_feature_request", "auto_handle", "fine", "Noted, thanks.", ["b"], "acknowledgement", ["b"]),
    (14, "playback_app", "auto_handle", "fine", "Какая версия?", ["b"], "clarification", ["b"]),
    (15, "feedback_feature_request", "auto_handle", "fine", "What would you change?", ["b"], "clarification", ["b"]),
    (16, "playback_app", "escalate", "angry", "That human support review is due", [], "handoff", []),
    (17, "feedback_feature_request", "auto_handle", "fine", "We hope to have it for everyone soon", ["b"], "answer", ["b"]),
    (18, "catalog_availability", "auto_handle", "fine", "x" * 1201, ["b"], "answer", ["b"]),
    (19, "other_unclear", "escalate", "empty", "Hello there", [], "handoff", []),
    (20, "playback_app", "escalate", "context", "Send us your password", [], "handoff", []),
    (21, "feedback_feature_request", "auto_handle", "fine", "\u2003Noted.\u00a0 \x0b ^AB\x1f", ["b"], "acknowledgement", ["b"]),
    (22, "library_playlists", "escalate", "fine", "[user]\u3000: we look backstage", [], "handoff", None),
    (23, "playback_app", "auto_handle", "no message", "Which device is it?", ["a"], "clarification", ["a"]),
    (24, "library_playlists", "auto_handle", "white space alone", "\n\t\x0b\u00a0\u2028", ["a"], "answer", ["a"]),
    (25, "library_playlists", "auto_handle", "no draft", None, ["a"], "answer", ["a"]),
    (26, "library_playlists", "auto_handle", "no citations", "By the menu.", None, "answer", ["a"]),
    (27, "library_playlists", "nonsense", "no such route", "By the menu.", ["a"], "answer", ["a"]),
    (28, "library_playlists", "auto_handle", "no allowed ids", "By the menu.", ["a"], "answer", None),
    (29, "library_playlists", "auto_handle", None, "By the menu.", ["a"], "answer", ["a"]),
    (30, "no intent", "auto_handle", "no such intent", "By the menu.", ["a"], "answer", ["a"]),
    (31, "library_playlists", "auto_handle", "no such kind", "By the menu.", ["a"], "advice", ["a"]),
    (32, "library_playlists", "auto_handle", "a null citation", "By the menu.", ["a", None], "answer", ["a"]),
]
OUTPUT_COLUMNS = "id int, intent string, route string, reason string, draft string, evidence_ids array<string>, reply_kind string, allowed_ids array<string>"

# (id, parent, ts): a chain, a cycle, an absent parent, a parent that is later than its child
CHAINS = [(1, None, 10), (2, 1, 20), (3, 2, 30), (10, 12, 10), (11, 10, 10), (12, 11, 10), (20, 999, 5), (21, 20, 6), (30, None, 50), (31, 30, 40), (32, 31, 45)]
CHAIN_COLUMNS = "id long, parent long, ts long"


def rows(spark: SparkSession, values: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(values, columns)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]::VARCHAR[]"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values_sql(values: list[tuple], columns: str) -> str:
    """A subquery with the same rows for an SQL engine."""
    import re

    names = re.findall(r"(?:^|, )(\w+) ", columns)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, v)) + ")" for v in values) + f") AS v({', '.join(names)}))"
