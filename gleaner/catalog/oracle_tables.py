"""The derived tables of ``tables.py`` as SQL common table expressions."""

from __future__ import annotations

import re

SOURCE = "CASE WHEN o_custkey % 3 = 0 THEN 'src0' ELSE 'src' || (o_custkey % 50) END"

CTES: dict[str, str] = {
    "articles": f"""
        SELECT o_orderkey AS id, {SOURCE} AS source_name,
               o_orderpriority || ' ' || (o_orderkey % 1000) AS title,
               CASE WHEN o_orderkey % 5 = 0 THEN 'HTTPS://Example.com:443/' ELSE 'https://example.com/' END
                 || {SOURCE} || '/' || o_orderkey AS url,
               'https://example.com/' || {SOURCE} || '/' || o_orderkey AS normalized_url,
               {SOURCE} || '-' || o_orderkey AS slug,
               CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'candidate' ELSE 'rejected' END AS status,
               CAST(o_orderkey % 5 AS INTEGER) AS retry_count,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS published_at,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL 2 DAY END AS collected_at,
               o_orderdate - INTERVAL 1 DAY AS created_at,
               o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS updated_at,
               CASE WHEN o_orderkey % 13 = 0 THEN 'old error' END AS error,
               lower(substr(o_orderpriority, 3, 20)) AS source_tags,
               CASE WHEN o_orderkey % 4 = 0 THEN 'kept text' END AS source_content
        FROM orders""",
    "log_base": """
        SELECT l_orderkey, (l_orderkey * 10 + l_linenumber) * 1001 - 1 + ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
                 ORDER BY l_shipdate, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS id,
               l_shipdate, l_partkey, l_suppkey, l_returnflag, l_linestatus
        FROM lineitem""",
    "fetches": """
        SELECT id, l_orderkey AS article_id, l_shipdate AS fetched_at,
               CASE WHEN l_linestatus = 'F' THEN 'failed' ELSE 'success' END AS status,
               CASE WHEN l_linestatus <> 'F' THEN ' body of part ' || l_partkey || ' from ' || l_suppkey || chr(10) END AS content,
               CASE WHEN l_linestatus = 'F' THEN 'timeout ' || l_suppkey END AS error,
               CASE WHEN l_linestatus <> 'F' AND l_partkey % 3 = 0 THEN l_shipdate - INTERVAL 30 DAY END AS published_at
        FROM log_base WHERE l_returnflag = 'A'""",
    "evaluations": """
        SELECT id, l_orderkey AS article_id, l_shipdate AS evaluated_at,
               ['accept', 'reject', 'low_confidence'][l_suppkey % 3 + 1] AS decision,
               ['technical_article', 'engineering_case', 'research_article', 'research_reflection', 'learning_path',
                'personal_reflection', 'career_experience', 'tooling_note'][l_partkey % 8 + 1] AS content_type,
               ' summary ' || l_partkey AS summary,
               [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), upper(split_part(p_name, ' ', 1)), ' '] AS tags,
               [split_part(p_name, ' ', 2) || '  Topic', p_brand, split_part(p_name, ' ', 1)] AS suggested_tags,
               'reason ' || l_suppkey AS recommendation_reason, 'model-' || (l_suppkey % 2) AS model_name
        FROM log_base JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N'""",
    "failures": """
        SELECT id, l_orderkey AS article_id, l_shipdate AS failed_at, 'invalid reply ' || l_suppkey AS error,
               CAST(l_suppkey % 3 + 1 AS INTEGER) AS attempts
        FROM log_base WHERE l_returnflag = 'R'""",
    "vocabulary": """
        SELECT MIN(p_partkey * 10 + pos) AS id, upper(substr(word, 1, 1)) || substr(word, 2) AS name, word AS normalized_name, word AS slug,
               'about ' || word AS description,
               CASE WHEN MIN(p_partkey * 10 + pos) % 2 = 0 THEN 'active' ELSE 'disabled' END AS status,
               TIMESTAMP '2020-01-01' AS created_at, TIMESTAMP '2020-01-01' AS updated_at
        FROM (SELECT p_partkey, 0 AS pos, split_part(p_name, ' ', 1) AS word FROM part
              UNION ALL SELECT p_partkey, 1, split_part(p_name, ' ', 2) FROM part) GROUP BY word""",
    "links": """
        SELECT DISTINCT e.article_id, v.id AS tag_id, e.id AS evaluation_id, e.evaluated_at AS created_at
        FROM evaluations e JOIN vocabulary v ON v.normalized_name = lower(e.tags[1]) OR v.normalized_name = lower(e.tags[2])
        WHERE e.id = (SELECT MAX(x.id) FROM evaluations x WHERE x.article_id = e.article_id)""",
    "tag_candidates": """
        SELECT id, article_id, id AS evaluation_id, suggested_tags[2] AS suggested_tag,
               lower(suggested_tags[2]) AS normalized_name,
               ['pending', 'approved', 'rejected', 'pending'][id % 4 + 1] AS status, 'seen in a verdict' AS reason,
               CAST(NULL AS TIMESTAMP) AS reviewed_at, evaluated_at AS created_at, evaluated_at AS updated_at
        FROM evaluations""",
    "stage_history": """
        SELECT event_id AS id, user_id AS article_id,
               CASE WHEN event_type IN ('signup', 'purchase') THEN 'evaluate' ELSE 'fetch' END AS stage,
               ['queued', 'running', 'succeeded', 'failed', 'skipped_out_of_range'][event_id % 5 + 1] AS status,
               CASE WHEN event_id % 5 = 3 THEN props END AS error, ts AS created_at
        FROM events""",
    "job_runs": """
        SELECT 'job-' || event_id AS job_id, event_type AS kind,
               ['queued', 'running', 'succeeded', 'failed', 'skipped'][event_id % 5 + 1] AS status,
               CASE WHEN user_id % 10 < 7 THEN 'schedule-' || (user_id % 7) END AS schedule_id, ts AS created_at,
               CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 1 SECOND END AS started_at,
               CASE WHEN event_id % 5 IN (2, 3) THEN ts + INTERVAL 1 SECOND + to_seconds(event_id % 100) END AS finished_at,
               props AS result_json
        FROM events""",
    "sources": """
        SELECT CAST(s_suppkey AS INTEGER) AS position, s_suppkey AS k, s_name AS name, n_name,
               s_suppkey % 6 <> 0 AS enabled,
               ['default', 'compact', 'featured', 'huge'][s_suppkey % 4 + 1] AS display,
               s_suppkey % 7 <> 0 AS has_feed,
               ['direct', 'rsshub', 'sitemap', 'listing', 'gopher'][s_suppkey % 5 + 1] AS type,
               CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN 'ftp://s' || s_suppkey
                    ELSE 'https://s' || s_suppkey || '.example.com/feed' END AS url,
               CASE WHEN s_suppkey % 17 = 0 THEN '//route' WHEN s_suppkey % 19 <> 0 THEN '/r/' || s_suppkey END AS route,
               CASE WHEN s_suppkey % 3 = 0 THEN 'https://hub.example.org//' END AS instance,
               CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE 'a' END AS link_selector,
               CASE WHEN s_suppkey % 23 = 0 THEN 'nowhere' END AS base_url,
               'https://s' || s_suppkey || '.example.com/' AS host, lower(n_name) AS tags
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "sightings": """
        SELECT CASE WHEN page_id % 3 = 0 THEN 'src0' ELSE 'src' || (page_id % 5) END AS source_name,
               page_id * 3 + n AS ordinal, page_id, n, url AS normalized_url,
               CASE WHEN page_id % 3 = 0 THEN 'Weekly notes' ELSE 'Page ' || page_id END AS title,
               CASE WHEN n = 0 THEN url WHEN n = 1 THEN 'HTTP' || substr(url, 5)
                    WHEN url LIKE 'https%' THEN regexp_replace(url, '^(https?)://([^/]+)', '\\1://\\2:443')
                    ELSE regexp_replace(url, '^(https?)://([^/]+)', '\\1://\\2:80') END AS url,
               CASE WHEN n = 1 THEN TIMESTAMP '2024-03-01' + to_days(CAST(page_id % 60 AS INTEGER)) END AS published_at,
               't' || n AS source_tags,
               CASE WHEN n = 2 THEN ' size ' || length(html) END AS source_content
        FROM pages, (VALUES (0), (1), (2)) AS v(n)""",
    "known_pages": """
        SELECT page_id AS id, 'old' AS source_name, 'Old title' AS title, url, url AS normalized_url,
               CASE WHEN page_id = 0 THEN 'src1-page-1' ELSE 'old-' || page_id END AS slug,
               CASE WHEN page_id % 8 = 0 THEN 'candidate' ELSE 'accepted' END AS status, 0 AS retry_count,
               CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-01-01' END AS published_at,
               TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at, 'old' AS source_tags,
               CASE WHEN page_id % 5 = 0 THEN 'old text' END AS source_content
        FROM pages WHERE page_id % 4 = 0""",
}


def iso(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%dT%H:%M:%SZ')"


def compose(query: str) -> str:
    """Put the derived tables a query names in front of it."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(query)
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    text = query.strip()
    if not needed:
        return text
    if text.upper().startswith("WITH "):
        return f"WITH {head},\n{text[5:]}"
    return f"WITH {head}\n{text}"
