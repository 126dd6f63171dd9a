"""All queries outside the text subpackage, and their SQL."""

from __future__ import annotations

from trellisq.plans import core_p, practice, practice_sql

FLAGSHIP = "q_recommend_balanced"

QUERIES = {**practice.QUERIES, **core_p.QUERIES}
SQL = {**practice_sql.SQL, **core_p.SQL}
