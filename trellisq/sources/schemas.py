"""Declared schemas of JSON inputs; nothing is inferred and every column may be null."""

from __future__ import annotations

PROBLEM = (
    "platform string, contest_id bigint, idx string, name string, rating int, tags array<string>, solved_count bigint, "
    "url string, catalog_pos bigint"
)
TASK = (
    "platform string, task_id bigint, name string, category string, url string, rating int, tags array<string>, "
    "solved_count bigint, attempt_count bigint"
)
SUBMISSION = (
    "submission_id bigint, user_id bigint, contest_id bigint, idx string, verdict string, prog_lang string, "
    "submitted_at timestamp, received_at timestamp"
)
RATING_CHANGE = "user_id bigint, at timestamp, new_rating int"
CONTEST = "contest_id bigint, name string, phase string, division int, start_at timestamp"
EDGE = "id bigint, from_slug string, to_slug string, edge_type string"
TOPIC_SEED = "id bigint, slug string, title string, category string, tags array<string>, prereqs array<string>, leads_to array<string>"
SOLVED_CACHE = "username string, updated_at string, solved_ids array<bigint>, solved_count bigint"
