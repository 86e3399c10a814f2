"""All registered queries of the core and their SQL."""

from __future__ import annotations

from stratalith.plans import data_jobs, lifecycle_jobs, retrieval_jobs, sql_jobs, text_jobs

FLAGSHIP = "search_bm25_topk"
QUERIES = {**data_jobs.QUERIES, **text_jobs.QUERIES, **retrieval_jobs.QUERIES, **lifecycle_jobs.QUERIES, **sql_jobs.QUERIES}
SQL = {**data_jobs.SQL, **text_jobs.SQL, **retrieval_jobs.SQL, **lifecycle_jobs.SQL, **sql_jobs.SQL}
