"""Tags: lookup, links, candidates, review, vocabulary upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import tables as t
from gleaner.catalog.oracle_tables import iso
from gleaner.catalog.registry import query
from gleaner.catalog.state_queries import AS_OF, as_of
from gleaner.operators import tags
from gleaner.plans import listings, paging, reports

_MENTIONS = r"""
    mentions AS (SELECT e.id AS evaluation_id, article_id, evaluated_at, m.origin, m.pos, m.name,
                   regexp_replace(lower(m.name), '\s+', ' ', 'g') AS normalized_name
                 FROM (SELECT *, unnest([{'origin': 0, 'pos': 0, 'name': tags[1]}, {'origin': 0, 'pos': 1, 'name': tags[2]},
                        {'origin': 0, 'pos': 2, 'name': tags[3]}, {'origin': 1, 'pos': 3, 'name': suggested_tags[1]},
                        {'origin': 1, 'pos': 4, 'name': suggested_tags[2]}, {'origin': 1, 'pos': 5, 'name': suggested_tags[3]}]) AS m
                       FROM evaluations) e)"""


@query(f"""
    WITH {_MENTIONS}
    SELECT m.evaluation_id, m.origin, m.name, m.normalized_name, v.id AS tag_id
    FROM mentions m LEFT JOIN vocabulary v ON v.normalized_name = m.normalized_name AND v.status = 'active'""")
def vocabulary_lookup(spark, sf):
    exploded = tags.exploded_tags(t.evaluations(spark, sf))
    return tags.vocabulary_lookup(exploded, t.vocabulary(spark, sf)).select(
        "evaluation_id", "origin", "name", "normalized_name", "tag_id"
    )


@query(f"""
    WITH {_MENTIONS},
         misses AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id, normalized_name ORDER BY evaluation_id, origin, pos) AS rn FROM mentions m
                    WHERE NOT EXISTS (SELECT 1 FROM vocabulary v WHERE v.normalized_name = m.normalized_name AND v.status = 'active'))
    SELECT article_id, evaluation_id, name AS suggested_tag, normalized_name, 'pending' AS status,
           CASE origin WHEN 0 THEN 'AI 评估将词库外标签放入 tags' ELSE 'AI 评估输出 suggested_tags 新标签建议' END AS reason, {iso('evaluated_at')} AS created_at
    FROM misses m WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM tag_candidates c WHERE c.article_id = m.article_id
                          AND c.normalized_name = m.normalized_name AND c.status = 'pending')""")
def new_tag_candidates(spark, sf):
    found = tags.new_tag_candidates(t.evaluations(spark, sf), t.tag_candidates(spark, sf), t.vocabulary(spark, sf))
    return found.drop("reviewed_at", "updated_at")


@query(f"""
    WITH {_MENTIONS},
         fresh AS (SELECT DISTINCT m.article_id, v.id AS tag_id, m.evaluation_id, m.evaluated_at AS created_at
                   FROM mentions m JOIN vocabulary v ON v.normalized_name = m.normalized_name AND v.status = 'active'
                   WHERE m.evaluation_id = (SELECT MAX(id) FROM evaluations x WHERE x.article_id = m.article_id)),
         merged AS (SELECT * FROM fresh UNION ALL
                    SELECT * FROM links WHERE article_id NOT IN (SELECT article_id FROM evaluations))
    SELECT article_id, tag_id, evaluation_id, {iso('created_at')} AS created_at FROM merged""")
def tag_links(spark, sf):
    return tags.sync_links(t.evaluations(spark, sf), t.links(spark, sf), t.vocabulary(spark, sf))


@query("""
    SELECT article_id, string_agg(name, '|' ORDER BY lower(name), name) AS tags
    FROM links l JOIN vocabulary v ON v.id = l.tag_id AND v.status = 'active' GROUP BY article_id""")
def public_tags(spark, sf):
    return tags.public_tags(t.links(spark, sf), t.vocabulary(spark, sf))


@query("SELECT id, name FROM vocabulary WHERE status = 'active'")
def active_vocabulary(spark, sf):
    return tags.active_tags(t.vocabulary(spark, sf))


# --- review ----------------------------------------------------------------------

def _reviewed(spark, sf):
    c = F.col("id")
    decisions = t.tag_candidates(spark, sf).select(
        c.alias("candidate_id"),
        F.when(c % 3 == 0, "approve").otherwise("reject").alias("action"),
        F.when(c % 27 == 0, F.lit(-1)).when(c % 9 == 0, F.lit(0)).cast("bigint").alias("tag_id"),
        F.when(c % 12 == 0, F.lit(" RING ")).when(c % 12 == 6, F.lit("Fresh  Idea")).when(c % 15 == 3, F.lit("  "))
        .when(c % 21 == 3, F.lit("fresh-idea")).when(c % 33 == 3, F.lit("Late-One")).when(c % 39 == 3, F.lit("late one")).alias("name"),
    )
    return tags.review(decisions, t.tag_candidates(spark, sf), t.vocabulary(spark, sf), t.links(spark, sf), as_of())


_REVIEW = """
    asked AS (SELECT id, article_id, evaluation_id, id % 3 = 0 AS approve,
                CASE WHEN id % 27 = 0 THEN -1 WHEN id % 9 = 0 THEN 0 END AS tag_id,
                CASE WHEN id % 12 = 0 THEN ' RING ' WHEN id % 12 = 6 THEN 'Fresh  Idea' WHEN id % 15 = 3 THEN '  '
                     WHEN id % 21 = 3 THEN 'fresh-idea' WHEN id % 33 = 3 THEN 'Late-One' WHEN id % 39 = 3 THEN 'late one' ELSE suggested_tag END AS wanted
              FROM tag_candidates),
    named AS (SELECT *, trim(regexp_replace(lower(wanted), ' +', ' ', 'g')) AS norm FROM asked WHERE approve AND tag_id IS NULL),
    wanted AS (SELECT norm, MIN(id) AS first_id, arg_min(wanted, id) AS wanted FROM named WHERE norm <> '' GROUP BY norm),
    unknown AS (SELECT *, replace(norm, ' ', '-') AS slug FROM wanted WHERE norm NOT IN (SELECT normalized_name FROM vocabulary)),
    created AS (SELECT (SELECT MAX(id) FROM vocabulary) + ROW_NUMBER() OVER (ORDER BY first_id) AS id, trim(wanted) AS name, norm AS normalized_name,
                  slug, '由 AI 标签候选审核通过创建' AS description, 'active' AS status
                FROM unknown u WHERE slug NOT IN (SELECT slug FROM vocabulary)
                  AND NOT EXISTS (SELECT 1 FROM unknown o WHERE o.slug = u.slug AND o.first_id < u.first_id)),
    refused AS (SELECT id FROM named JOIN unknown USING (norm) WHERE norm NOT IN (SELECT normalized_name FROM created)),
    vocab AS (SELECT id, name, normalized_name, slug, description, CASE WHEN normalized_name IN (SELECT norm FROM wanted) THEN 'active' ELSE status END AS status
              FROM vocabulary UNION ALL SELECT * FROM created),
    approved AS (SELECT id, article_id, evaluation_id, CAST(tag_id AS BIGINT) AS tag_id FROM asked WHERE approve AND tag_id = 0
                 UNION ALL SELECT n.id, n.article_id, n.evaluation_id, v.id FROM named n JOIN vocab v ON v.normalized_name = n.norm)"""


@query(f"WITH {_REVIEW} SELECT * FROM vocab")
def reviewed_vocabulary(spark, sf):
    return _reviewed(spark, sf)["vocabulary"].drop("created_at", "updated_at")


@query(f"""
    WITH {_REVIEW}
    SELECT id, CASE WHEN id IN (SELECT id FROM approved) THEN 'approved' WHEN id % 3 <> 0 THEN 'rejected' ELSE status END AS status,
           CASE WHEN id IN (SELECT id FROM approved) OR id % 3 <> 0 THEN '{AS_OF.replace(' ', 'T')}Z' END AS reviewed_at
    FROM tag_candidates""")
def reviewed_candidates(spark, sf):
    return _reviewed(spark, sf)["candidates"].select("id", "status", "reviewed_at")


@query(f"""
    WITH {_REVIEW}
    SELECT article_id, tag_id, evaluation_id FROM links
    UNION ALL
    SELECT article_id, tag_id, MIN(evaluation_id) FROM approved a
    WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.article_id = a.article_id AND l.tag_id = a.tag_id) GROUP BY article_id, tag_id""")
def reviewed_links(spark, sf):
    return _reviewed(spark, sf)["links"].select("article_id", "tag_id", "evaluation_id")


@query(f"""
    WITH {_REVIEW}
    SELECT id AS candidate_id, 'tag not found' AS error FROM asked WHERE approve AND tag_id = -1
    UNION ALL SELECT id, 'tag name must not be empty' FROM named WHERE norm = ''
    UNION ALL SELECT id, 'tag already exists' FROM refused""")
def review_errors(spark, sf):
    """A blank name falls back to the suggested one only when it is absent."""
    return _reviewed(spark, sf)["errors"]


# --- vocabulary upkeep -------------------------------------------------------------

def _changed(spark, sf):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    kind = k % 50
    changes = t.read(spark, sf, "part").select(
        k.alias("ordinal"),
        F.when(k % 3 == 0, F.lit(None)).when(kind == 5, F.lit(-5)).otherwise(F.lit(0)).cast("bigint").alias("tag_id"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" ")))
        .when(kind == 1, F.concat(F.lit("Renamed  "), k.cast("string")))
        .when(kind == 4, F.lit("RED"))
        .when(kind == 5, F.col("p_brand")).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit(" from "), k.cast("string"))).otherwise(none).alias("description"),
        F.when((k % 3 != 0) & (kind == 2), F.lit("disabled")).alias("status"),
    )
    return tags.change_vocabulary(t.vocabulary(spark, sf), changes, as_of())


_CHANGES = """
    c AS (SELECT p_partkey AS k, p_brand, p_partkey % 50 AS kind, p_partkey % 3 = 0 AS creates FROM part),
    firsts AS (SELECT p_brand, MIN(k) AS k FROM c WHERE creates GROUP BY p_brand)"""


@query(f"""
    WITH {_CHANGES},
         renamed AS (SELECT 'Renamed  ' || MAX(k) AS name, 'renamed ' || MAX(k) AS norm FROM c WHERE NOT creates AND kind = 1),
         touched AS (SELECT COUNT(*) > 0 AS off FROM c WHERE NOT creates AND kind = 2)
    SELECT id, CASE WHEN id = 0 THEN (SELECT name FROM renamed) ELSE name END AS name,
           CASE WHEN id = 0 THEN (SELECT norm FROM renamed) ELSE normalized_name END AS normalized_name,
           CASE WHEN id = 0 THEN replace((SELECT norm FROM renamed), ' ', '-') ELSE slug END AS slug, description,
           CASE WHEN id = 0 AND (SELECT off FROM touched) THEN 'disabled' ELSE status END AS status,
           CASE WHEN id = 0 THEN '{AS_OF.replace(' ', 'T')}Z' ELSE {iso('updated_at')} END AS updated_at
    FROM vocabulary
    UNION ALL
    SELECT (SELECT MAX(id) FROM vocabulary) + ROW_NUMBER() OVER (ORDER BY k), p_brand, lower(p_brand), lower(p_brand), 'from ' || k, 'active',
           '{AS_OF.replace(' ', 'T')}Z' FROM firsts""")
def changed_vocabulary(spark, sf):
    return _changed(spark, sf)[0].drop("created_at")


@query(f"""
    WITH {_CHANGES}
    SELECT k AS ordinal, CASE WHEN NOT creates AND kind = 5 THEN 'tag not found' ELSE 'tag already exists' END AS error
    FROM c WHERE (creates AND k NOT IN (SELECT k FROM firsts)) OR (NOT creates AND kind IN (4, 5))""")
def refused_changes(spark, sf):
    return _changed(spark, sf)[1].select("ordinal", "error")


_USED = """
    used AS (SELECT id AS evaluation_id, article_id, evaluated_at, m.pos, m.name, lower(m.name) AS norm
             FROM (SELECT *, unnest([{'pos': 0, 'name': tags[1]}, {'pos': 1, 'name': tags[2]}, {'pos': 2, 'name': tags[3]}]) AS m FROM evaluations) e),
    added AS (SELECT (SELECT MAX(id) FROM vocabulary) + ROW_NUMBER() OVER (ORDER BY evaluation_id, pos) AS id, name, norm, evaluated_at
              FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY norm ORDER BY evaluation_id, pos) AS rn FROM used)
              WHERE rn = 1 AND norm NOT IN (SELECT normalized_name FROM vocabulary))"""


@query(f"""
    WITH {_USED}
    SELECT id, name, norm AS normalized_name, norm AS slug, '历史评估标签迁移导入' AS description, 'active' AS status,
           {iso('evaluated_at')} AS created_at FROM added""")
def bootstrapped_vocabulary(spark, sf):
    return tags.bootstrap_vocabulary(t.evaluations(spark, sf), t.vocabulary(spark, sf))[0].drop("updated_at")


@query(f"""
    WITH {_USED},
         names AS (SELECT normalized_name AS norm, id FROM vocabulary UNION ALL SELECT norm, id FROM added)
    SELECT article_id, n.id AS tag_id, MIN(evaluation_id) AS evaluation_id FROM used JOIN names n USING (norm) GROUP BY article_id, n.id""")
def bootstrapped_links(spark, sf):
    return tags.bootstrap_vocabulary(t.evaluations(spark, sf), t.vocabulary(spark, sf))[1].drop("created_at")


# --- listings --------------------------------------------------------------------

@query("""
    SELECT v.id, v.name, v.status, (SELECT COUNT(*) FROM links l WHERE l.tag_id = v.id) AS article_count FROM vocabulary v""")
def tag_counts(spark, sf):
    return reports.tag_counts(t.vocabulary(spark, sf), t.links(spark, sf))


@query("""
    SELECT v.id, v.name, v.status, v.description, (SELECT COUNT(*) FROM links l WHERE l.tag_id = v.id) AS article_count FROM vocabulary v
    WHERE v.name ILIKE '%l%' OR v.description ILIKE '%l%' ORDER BY v.status, lower(v.name), v.name LIMIT 5 OFFSET 1""")
def tag_page(spark, sf):
    page = listings.tag_page(t.vocabulary(spark, sf), t.links(spark, sf), q=" L ", limit=5, offset=1)
    return page.select("id", "name", "status", "description", "article_count")


@query(f"""
    SELECT c.id, c.article_id, c.suggested_tag, c.status, {iso('c.created_at')} AS created_at, a.title AS article_title,
           a.url AS article_url, a.status AS article_status
    FROM tag_candidates c JOIN articles a ON a.id = c.article_id WHERE c.status = 'pending'
    ORDER BY c.created_at DESC, c.id DESC LIMIT 40 OFFSET 20""")
def tag_candidate_page(spark, sf):
    page = listings.candidate_page(t.tag_candidates(spark, sf), t.articles(spark, sf), limit=40, offset=20)
    return page.select(
        "id", "article_id", "suggested_tag", "status", "created_at", "article_title", "article_url", "article_status"
    )


@query("""
    WITH page AS (SELECT * FROM vocabulary ORDER BY status, lower(name), name, id LIMIT 5 OFFSET 3)
    SELECT ROW_NUMBER() OVER (ORDER BY status, lower(name), name, id) AS position, id, name, status,
           (SELECT COUNT(*) FROM links l WHERE l.tag_id = page.id) AS article_count, (SELECT COUNT(*) FROM vocabulary) AS total FROM page""")
def tag_listing(spark, sf):
    """The page after the first three tags, with the total."""
    words, links = t.vocabulary(spark, sf), t.links(spark, sf)
    first = paging.cursor_page(listings.tag_rows(words, links), listings.TAG_KEYS, 3)
    page = listings.tag_listing(words, links, limit=5, cursor=paging.cursor_of(first, listings.TAG_KEYS))
    return page.select("total", F.posexplode("items").alias("at", "item")).select(
        (F.col("at") + 1).cast("long").alias("position"), "item.id", "item.name", "item.status", "item.article_count", "total"
    )


@query("""
    WITH page AS (SELECT * FROM tag_candidates WHERE status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 60)
    SELECT ROW_NUMBER() OVER (ORDER BY c.created_at DESC, c.id DESC) AS position, c.id, c.suggested_tag, a.title AS article_title,
           (SELECT COUNT(*) FROM tag_candidates WHERE status = 'pending') AS total
    FROM page c JOIN articles a ON a.id = c.article_id""")
def candidate_listing(spark, sf):
    """The page after the first sixty pending candidates, with the total."""
    candidates = t.tag_candidates(spark, sf)
    first = paging.cursor_page(candidates.filter("status = 'pending'"), listings.CANDIDATE_KEYS, 60)
    page = listings.candidate_listing(candidates, t.articles(spark, sf), limit=40, cursor=paging.cursor_of(first, listings.CANDIDATE_KEYS))
    return page.select("total", F.posexplode("items").alias("at", "item")).select(
        (F.col("at") + 1).cast("long").alias("position"), "item.id", "item.suggested_tag", "item.article_title", "total"
    )
