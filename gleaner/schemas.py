"""Explicit schemas of the tables the jobs read and write."""

from __future__ import annotations

MANUAL_URL = "struct<url:string,title:string,published_at:string,tags:array<string>>"
FEED = (
    "struct<type:string,url:string,route:string,instance:string,params:map<string,string>,"
    "link_selector:string,title_selector:string,url_patterns:array<string>,base_url:string>"
)
SOURCES = (
    f"position int, name string, enabled boolean, display string, feed {FEED}, site_url string, "
    f"tags array<string>, manual_urls array<{MANUAL_URL}>"
)
RAW_BODIES = "source_name string, body string, http_status int, etag string, modified string, fetch_error string"
ENTRIES = (
    "source_name string, ordinal bigint, title string, url string, published_at timestamp, "
    "source_tags array<string>, source_content string, source_content_metadata map<string,string>"
)
ARTICLES = (
    "id bigint, source_name string, title string, url string, normalized_url string, slug string, status string, "
    "retry_count int, published_at timestamp, collected_at timestamp, created_at timestamp, updated_at timestamp, "
    "error string, source_tags array<string>, source_content string, source_content_metadata map<string,string>"
)
FETCHES = (
    "id bigint, article_id bigint, fetched_at timestamp, status string, content string, error string, "
    "metadata map<string,string>, published_at timestamp"
)
EVALUATIONS = (
    "id bigint, article_id bigint, evaluated_at timestamp, decision string, content_type string, summary string, "
    "tags array<string>, suggested_tags array<string>, recommendation_reason string, model_name string, raw_json string"
)
EVALUATION_FAILURES = (
    "id bigint, article_id bigint, failed_at timestamp, error string, attempts int, raw_response string"
)
SOURCE_STATE = (
    "source_name string, etag string, modified string, last_status string, last_error string, checked_at timestamp"
)
VOCABULARY = (
    "id bigint, name string, normalized_name string, slug string, description string, status string, "
    "created_at timestamp, updated_at timestamp"
)
ARTICLE_TAGS = "article_id bigint, tag_id bigint, evaluation_id bigint, created_at timestamp"
TAG_CANDIDATES = (
    "id bigint, article_id bigint, evaluation_id bigint, suggested_tag string, normalized_name string, "
    "status string, reason string, reviewed_at timestamp, created_at timestamp, updated_at timestamp"
)
STAGE_HISTORY = (
    "id bigint, article_id bigint, stage string, status string, job_id string, range_since timestamp, "
    "range_until timestamp, error string, created_at timestamp, started_at timestamp, finished_at timestamp"
)
JOB_RUNS = (
    "job_id string, kind string, status string, trigger string, schedule_id string, target_article_id bigint, "
    "created_at timestamp, started_at timestamp, finished_at timestamp, result_json string, error string"
)
