"""Schemas of the data model, and its enumerated domains as fixed values."""

from __future__ import annotations

ARCHIVE = "tweet_id bigint, author_id string, inbound boolean, created_at timestamp, text string, response_ids array<bigint>, parent_id bigint"
TURN = "struct<tweet_id: string, role: string, text: string, created_at: string>"
STATUS = "struct<missing_parent: boolean, cycle: boolean, timestamp_conflict: boolean>"
EXAMPLE = f"tweet_id string, component_id string, split string, challenge_selection_reason string, message string, created_at string, context array<{TURN}>, context_status {STATUS}"
HISTORY = "component_id string, customer_tweet_id string, support_tweet_id string, customer_message string, historical_reply string, created_at string, resolution_verified boolean"
LABEL = "intent string, route string, reason string, flag string, notes string, updated_at string"
RAW_OUTPUT = "intent string, route string, reason string, draft string, evidence_ids array<string>, reply_kind string"
OUTPUT_FIELDS = ("intent", "route", "reason", "draft", "evidence_ids", "reply_kind")
RATING = "correctness string, grounding string, usefulness string, routing_privacy string, critical_failure string, notes string, updated_at string"
JUDGE = "rating_id string, correctness int, grounding int, usefulness int, routing_privacy int, critical_failure boolean, rationale string, api_metadata string"
CACHE = "fingerprint string, parsed string, metadata string"

# The domains of labels, routes, kinds and rating dimensions.
INTENTS = (
    "billing_subscription", "account_access_security", "playback_app", "library_playlists",
    "catalog_availability", "feedback_feature_request", "social_acknowledgement", "other_unclear",
)
ROUTES = ("auto_handle", "escalate")
REPLY_KINDS = ("answer", "clarification", "acknowledgement", "handoff")
REASONS = (
    "account_action", "security_privacy", "sensitive_safety", "insufficient_context", "unsupported_language_scope",
    "unverified_policy", "repeated_failure", "safe_clarification", "safe_acknowledgement", "supported_general_help",
)
FLAGS = ("", "Unsure", "Discuss")
DIMENSIONS = ("correctness", "grounding", "usefulness", "routing_privacy")
