"""SQL twins in DuckDB's dialect, put together from named common table expressions."""

from __future__ import annotations

import re

from ..schemas import CONTENT_GRID, ITEM_CF_GRID

# Each expression may use those above it.
CTES: dict[str, str] = {
    "bronze_events": """SELECT epoch_us(ts) // 1000 AS "timestamp", user_id AS visitorid,
        CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid,
        CASE WHEN event_type = 'purchase' THEN event_id END AS transactionid FROM events""",
    "order_events": """SELECT epoch_us(l_shipdate) // 1000 AS ms, o_custkey AS visitor_id, l_partkey AS item_id,
        CASE l_returnflag WHEN 'N' THEN 'view' WHEN 'A' THEN 'addtocart' ELSE 'transaction' END AS event_type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "silver": """SELECT strftime(make_timestamp(("timestamp" // 1000) * 1000000), '%Y-%m-%d %H:%M:%S') AS event_timestamp,
        visitorid AS visitor_id, itemid AS item_id, event AS event_type, transactionid AS transaction_id, "timestamp" AS event_timestamp_ms
        FROM bronze_events WHERE event IN ('view', 'addtocart', 'transaction') AND visitorid >= 0 AND itemid >= 0 AND "timestamp" > 0""",
    "properties": """SELECT CAST(1000 AS BIGINT) AS "timestamp", p_partkey AS itemid, property, value FROM (
        SELECT p_partkey, unnest(['categoryid', 'available', 'p_name', 'p_type', 'p_size', 'p_price']) AS property,
          unnest([regexp_extract(p_brand, '([0-9]+)$', 1), CASE WHEN p_size <= 40 THEN '1' ELSE '0' END, p_name, p_type,
            CAST(p_size AS VARCHAR), CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)]) AS value FROM part)""",
    "hierarchy": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS category_id, CAST(n_regionkey AS BIGINT) AS parent_category_id FROM nation",
    "products": """SELECT itemid AS item_id, max(CASE WHEN property = 'categoryid' THEN TRY_CAST(value AS BIGINT) END) AS category_id,
        max(CASE WHEN property = 'available' THEN TRY_CAST(value AS BIGINT) END) AS available,
        list(property || '_' || value ORDER BY property) FILTER (property NOT IN ('categoryid', 'available')) AS encoded
        FROM properties GROUP BY itemid""",
    "catalog": "SELECT p.item_id, p.category_id, h.parent_category_id, p.available, p.encoded FROM products p LEFT JOIN hierarchy h USING (category_id)",
    "tokens": """SELECT item_id, unnest(encoded) AS token FROM catalog
        UNION ALL SELECT item_id, 'category:' || category_id FROM catalog WHERE category_id IS NOT NULL
        UNION ALL SELECT item_id, 'parent_category:' || parent_category_id FROM catalog WHERE parent_category_id IS NOT NULL""",
    "vectors": """SELECT item_id, CAST(CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 256 AS INTEGER) AS bucket,
        sum(CASE WHEN CAST('0x' || substr(md5(token), 9, 1) AS BIGINT) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS value
        FROM tokens GROUP BY 1, 2""",
    "gold": """SELECT visitor_id, item_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS view_count,
        CAST(sum(CASE WHEN event_type = 'addtocart' THEN 1 ELSE 0 END) AS BIGINT) AS cart_count,
        CAST(sum(CASE WHEN event_type = 'transaction' THEN 1 ELSE 0 END) AS BIGINT) AS purchase_count,
        CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'addtocart' THEN 3 ELSE 5 END) AS BIGINT) AS interaction_score,
        strftime(make_timestamp((max(event_timestamp_ms) // 1000) * 1000000), '%Y-%m-%d %H:%M:%S') AS last_interaction_timestamp
        FROM silver GROUP BY 1, 2""",
    "order_gold": """SELECT visitor_id, item_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS view_count,
        CAST(sum(CASE WHEN event_type = 'addtocart' THEN 1 ELSE 0 END) AS BIGINT) AS cart_count,
        CAST(sum(CASE WHEN event_type = 'transaction' THEN 1 ELSE 0 END) AS BIGINT) AS purchase_count,
        CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'addtocart' THEN 3 ELSE 5 END) AS BIGINT) AS interaction_score,
        strftime(make_timestamp((max(ms) // 1000) * 1000000), '%Y-%m-%d %H:%M:%S') AS last_interaction_timestamp
        FROM order_events WHERE visitor_id >= 0 AND item_id >= 0 AND ms > 0 GROUP BY 1, 2""",
    "activity": """SELECT visitor_id, count(*) AS distinct_items, CAST(sum(view_count + cart_count + purchase_count) AS BIGINT) AS total_events,
        CAST(sum(view_count) AS BIGINT) AS view_count, CAST(sum(cart_count) AS BIGINT) AS cart_count, CAST(sum(purchase_count) AS BIGINT) AS purchase_count,
        CAST(sum(interaction_score) AS BIGINT) AS total_interaction_score, CAST(sum(interaction_score) AS DOUBLE) / count(*) AS avg_interaction_score,
        coalesce(CAST(sum(purchase_count) AS DOUBLE) / nullif(sum(view_count + cart_count + purchase_count), 0), 0.0) AS purchase_rate,
        max(last_interaction_timestamp) AS last_active_timestamp FROM gold GROUP BY visitor_id""",
    "item_totals": """SELECT item_id, count(*) AS distinct_users, sum(view_count) AS view_count, sum(cart_count) AS cart_count,
        sum(purchase_count) AS purchase_count, sum(interaction_score) AS score FROM gold GROUP BY item_id""",
    "popularity_features": """SELECT c.item_id, c.category_id, c.parent_category_id, c.available, CAST(coalesce(t.distinct_users, 0) AS BIGINT) AS distinct_users,
        CAST(coalesce(t.view_count, 0) AS BIGINT) AS view_count, CAST(coalesce(t.cart_count, 0) AS BIGINT) AS cart_count,
        CAST(coalesce(t.purchase_count, 0) AS BIGINT) AS purchase_count, CAST(coalesce(t.score, 0) AS BIGINT) AS total_interaction_score,
        coalesce(CAST(t.score AS DOUBLE) / nullif(t.distinct_users, 0), 0.0) AS avg_interaction_score,
        coalesce(CAST(t.purchase_count AS DOUBLE) / nullif(t.view_count, 0), 0.0) AS conversion_rate,
        CAST(row_number() OVER (ORDER BY coalesce(t.score, 0) DESC, c.item_id) AS BIGINT) AS popularity_rank
        FROM catalog c LEFT JOIN item_totals t USING (item_id)""",
    "bounds": "SELECT min(event_timestamp_ms) AS minimum_ms, max(event_timestamp_ms) AS maximum_ms, max(event_timestamp_ms) - 14 * 86400000 AS cutoff_ms FROM silver",
    "train": """SELECT visitor_id, item_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS view_count,
        CAST(sum(CASE WHEN event_type = 'addtocart' THEN 1 ELSE 0 END) AS BIGINT) AS cart_count,
        CAST(sum(CASE WHEN event_type = 'transaction' THEN 1 ELSE 0 END) AS BIGINT) AS purchase_count,
        CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'addtocart' THEN 3 ELSE 5 END) AS BIGINT) AS interaction_score,
        max(event_timestamp_ms) AS last_interaction_timestamp_ms FROM silver, bounds WHERE event_timestamp_ms < cutoff_ms GROUP BY 1, 2""",
    "available": "SELECT item_id FROM products WHERE available = 1",
    "targets": """SELECT e.visitor_id, e.item_id, count(*) AS target_events FROM silver e, bounds WHERE event_timestamp_ms >= cutoff_ms
        AND event_type = 'transaction' AND e.item_id IN (FROM available)
        AND NOT EXISTS (SELECT 1 FROM train t WHERE t.visitor_id = e.visitor_id AND t.item_id = e.item_id) GROUP BY 1, 2""",
    "targets_high": """SELECT e.visitor_id, e.item_id, count(*) AS target_events FROM silver e, bounds WHERE event_timestamp_ms >= cutoff_ms
        AND event_type IN ('addtocart', 'transaction') AND e.item_id IN (FROM available)
        AND NOT EXISTS (SELECT 1 FROM train t WHERE t.visitor_id = e.visitor_id AND t.item_id = e.item_id) GROUP BY 1, 2""",
    "popular": """SELECT item_id, CAST(sum(interaction_score) AS BIGINT) AS score,
        CAST(row_number() OVER (ORDER BY sum(interaction_score) DESC, item_id) AS BIGINT) AS rank
        FROM train WHERE item_id IN (FROM available) GROUP BY item_id""",
    "visitors": "SELECT DISTINCT visitor_id FROM targets",
    "history": "SELECT visitor_id, item_id, CAST(interaction_score AS DOUBLE) AS score FROM train WHERE visitor_id IN (FROM visitors)",
    "capped": """SELECT visitor_id, item_id, interaction_score FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id
        ORDER BY interaction_score DESC, last_interaction_timestamp_ms DESC, item_id) AS n FROM train) WHERE n <= 30""",
    "pairs": """SELECT a.item_id AS item_i, b.item_id AS item_j, sum(CAST(a.interaction_score AS DOUBLE) * b.interaction_score) AS dot_product,
        count(*) AS cooccurring_users FROM capped a JOIN capped b ON a.visitor_id = b.visitor_id AND a.item_id < b.item_id GROUP BY 1, 2""",
    "norms": "SELECT item_id, sum(CAST(interaction_score AS DOUBLE) * interaction_score) AS norm_squared FROM train GROUP BY 1",
    "directed": """SELECT item_i AS source_item_id, item_j AS similar_item_id, dot_product / sqrt(a.norm_squared * b.norm_squared) AS similarity, cooccurring_users
        FROM pairs JOIN norms a ON a.item_id = item_i JOIN norms b ON b.item_id = item_j WHERE cooccurring_users >= 2""",
    "neighbours": """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_item_id
        ORDER BY similarity DESC, cooccurring_users DESC, similar_item_id) AS BIGINT) AS neighbor_rank FROM (
          FROM directed UNION ALL SELECT similar_item_id, source_item_id, similarity, cooccurring_users FROM directed)) WHERE neighbor_rank <= 50""",
    "cf": """SELECT * FROM (SELECT visitor_id, item_id, score, CAST(row_number() OVER (PARTITION BY visitor_id ORDER BY score DESC, item_id) AS BIGINT) AS rank FROM (
        SELECT h.visitor_id, s.similar_item_id AS item_id, round(sum(h.score * s.similarity), 9) AS score FROM history h JOIN neighbours s ON s.source_item_id = h.item_id
        WHERE s.similar_item_id IN (FROM available) AND NOT EXISTS (SELECT 1 FROM history x WHERE x.visitor_id = h.visitor_id AND x.item_id = s.similar_item_id)
        GROUP BY 1, 2)) WHERE rank <= 100""",
    "units": """SELECT item_id, bucket, value / CASE WHEN norm = 0 THEN 1 ELSE norm END AS weight
        FROM vectors JOIN (SELECT item_id, sqrt(sum(value * value)) AS norm FROM vectors GROUP BY 1) USING (item_id)""",
    "summed": "SELECT h.visitor_id, u.bucket, sum(ln(1 + h.score) * u.weight) AS w FROM history h JOIN units u USING (item_id) GROUP BY 1, 2",
    "profile": "SELECT visitor_id, bucket, w / norm AS weight FROM summed JOIN (SELECT visitor_id, sqrt(sum(w * w)) AS norm FROM summed GROUP BY 1 HAVING sum(w * w) > 0) USING (visitor_id)",
    "known": "SELECT h.visitor_id, c.category_id, c.parent_category_id, ln(1 + h.score) AS w FROM history h JOIN catalog c USING (item_id)",
    "category_share": """SELECT visitor_id, category_id, sum(w) / any_value(total) AS affinity FROM known
        JOIN (SELECT visitor_id, sum(w) AS total FROM known GROUP BY 1) USING (visitor_id) WHERE category_id IS NOT NULL GROUP BY 1, 2""",
    "parent_share": """SELECT visitor_id, parent_category_id, sum(w) / any_value(total) AS affinity FROM known
        JOIN (SELECT visitor_id, sum(w) AS total FROM known GROUP BY 1) USING (visitor_id) WHERE parent_category_id IS NOT NULL GROUP BY 1, 2""",
    "cosines": "SELECT p.visitor_id, u.item_id, sum(p.weight * u.weight) AS cosine FROM profile p JOIN units u USING (bucket) GROUP BY 1, 2",
    # all visitors with a profile times all available items: the dense form
    "content_dense": """SELECT v.visitor_id, c.item_id, coalesce(x.cosine, 0) AS cosine, coalesce(a.affinity, 0) AS category, coalesce(b.affinity, 0) AS parent
        FROM (SELECT DISTINCT visitor_id FROM profile) v CROSS JOIN (SELECT * FROM catalog WHERE available = 1) c
        LEFT JOIN cosines x ON x.visitor_id = v.visitor_id AND x.item_id = c.item_id
        LEFT JOIN category_share a ON a.visitor_id = v.visitor_id AND a.category_id = c.category_id
        LEFT JOIN parent_share b ON b.visitor_id = v.visitor_id AND b.parent_category_id = c.parent_category_id
        WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.visitor_id = v.visitor_id AND h.item_id = c.item_id)""",
    "content": """SELECT * FROM (SELECT visitor_id, item_id, score, CAST(row_number() OVER (PARTITION BY visitor_id ORDER BY score DESC, item_id) AS BIGINT) AS rank
        FROM (SELECT visitor_id, item_id, round(0.8::DOUBLE * cosine + 0.15::DOUBLE * category + 0.05::DOUBLE * parent, 9) AS score FROM content_dense)) WHERE rank <= 100""",
    "fused": """SELECT visitor_id, item_id, round(sum(s), 9) AS score FROM (
        SELECT visitor_id, item_id, 0.6::DOUBLE / (20.0::DOUBLE + rank) AS s FROM cf UNION ALL SELECT visitor_id, item_id, 0.4::DOUBLE / (20.0::DOUBLE + rank) FROM content) GROUP BY 1, 2""",
    "ranked": """SELECT 'item_collaborative_filtering' AS model, visitor_id, item_id, rank FROM cf WHERE rank <= 10
        UNION ALL SELECT 'content_similarity', visitor_id, item_id, rank FROM content WHERE rank <= 10
        UNION ALL SELECT 'item_cf_content_hybrid', visitor_id, item_id, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY score DESC, item_id) AS rank FROM fused) WHERE rank <= 10""",
    "gold_capped": """SELECT visitor_id, item_id, interaction_score FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id
        ORDER BY interaction_score DESC, last_interaction_timestamp DESC, item_id) AS n FROM gold) WHERE n <= 30""",
    "gold_pairs": """SELECT a.item_id AS i, b.item_id AS j FROM gold_capped a JOIN gold_capped b ON a.visitor_id = b.visitor_id AND a.item_id < b.item_id
        GROUP BY 1, 2 HAVING count(*) >= 2""",
    "gold_degrees": "SELECT item, least(count(*), 50) AS n FROM (SELECT i AS item FROM gold_pairs UNION ALL SELECT j FROM gold_pairs) GROUP BY 1",
    "gold_neighbours": "SELECT unnest(range(n)) AS k, item FROM gold_degrees",
    # serving: the same chain over the latest items of the whole timeline
    "s_history": """SELECT visitor_id, item_id, CAST(interaction_score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id
        ORDER BY last_interaction_timestamp DESC, interaction_score DESC, item_id) AS n FROM gold) WHERE n <= 30""",
    "s_cf": """SELECT * FROM (SELECT visitor_id, item_id, row_number() OVER (PARTITION BY visitor_id ORDER BY score DESC, item_id) AS rank FROM (
        SELECT h.visitor_id, s.similar_item_id AS item_id, round(sum(h.score * s.similarity), 9) AS score FROM s_history h JOIN neighbours s ON s.source_item_id = h.item_id
        WHERE s.similar_item_id IN (FROM available) AND NOT EXISTS (SELECT 1 FROM s_history x WHERE x.visitor_id = h.visitor_id AND x.item_id = s.similar_item_id)
        GROUP BY 1, 2)) WHERE rank <= 100""",
    "s_summed": "SELECT h.visitor_id, u.bucket, sum(ln(1 + h.score) * u.weight) AS w FROM s_history h JOIN units u USING (item_id) GROUP BY 1, 2",
    "s_profile": "SELECT visitor_id, bucket, w / norm AS weight FROM s_summed JOIN (SELECT visitor_id, sqrt(sum(w * w)) AS norm FROM s_summed GROUP BY 1 HAVING sum(w * w) > 0) USING (visitor_id)",
    "s_known": "SELECT h.visitor_id, c.category_id, c.parent_category_id, ln(1 + h.score) AS w FROM s_history h JOIN catalog c USING (item_id)",
    "s_total": "SELECT visitor_id, sum(w) AS total FROM s_known GROUP BY 1",
    "s_category": "SELECT visitor_id, category_id, sum(w) / any_value(total) AS affinity FROM s_known JOIN s_total USING (visitor_id) WHERE category_id IS NOT NULL GROUP BY 1, 2",
    "s_parent": "SELECT visitor_id, parent_category_id, sum(w) / any_value(total) AS affinity FROM s_known JOIN s_total USING (visitor_id) WHERE parent_category_id IS NOT NULL GROUP BY 1, 2",
    "s_cosines": "SELECT p.visitor_id, u.item_id, sum(p.weight * u.weight) AS cosine FROM s_profile p JOIN units u USING (bucket) GROUP BY 1, 2",
    "s_content": """SELECT * FROM (SELECT visitor_id, item_id, row_number() OVER (PARTITION BY visitor_id ORDER BY score DESC, item_id) AS rank FROM (
        SELECT v.visitor_id, c.item_id, round(0.8::DOUBLE * coalesce(x.cosine, 0) + 0.15::DOUBLE * coalesce(a.affinity, 0) + 0.05::DOUBLE * coalesce(b.affinity, 0), 9) AS score
        FROM (SELECT DISTINCT visitor_id FROM s_profile) v CROSS JOIN (SELECT * FROM catalog WHERE available = 1) c
        LEFT JOIN s_cosines x ON x.visitor_id = v.visitor_id AND x.item_id = c.item_id
        LEFT JOIN s_category a ON a.visitor_id = v.visitor_id AND a.category_id = c.category_id
        LEFT JOIN s_parent b ON b.visitor_id = v.visitor_id AND b.parent_category_id = c.parent_category_id
        WHERE NOT EXISTS (SELECT 1 FROM s_history h WHERE h.visitor_id = v.visitor_id AND h.item_id = c.item_id))) WHERE rank <= 100""",
    "s_fused": """SELECT visitor_id, item_id, round(sum(s), 9) AS score, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM (
        SELECT visitor_id, item_id, 0.6::DOUBLE / (20.0::DOUBLE + rank) AS s, 'item_cf' AS source FROM s_cf
        UNION ALL SELECT visitor_id, item_id, 0.4::DOUBLE / (20.0::DOUBLE + rank), 'content' FROM s_content) GROUP BY 1, 2""",
    "asked": "SELECT DISTINCT visitor_id FROM gold UNION SELECT -1",
    "s_ranked": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY score DESC, item_id) AS rank FROM s_fused) WHERE rank <= 10",
    "s_lengths": "SELECT a.visitor_id, count(r.item_id) AS n FROM asked a LEFT JOIN s_ranked r ON r.visitor_id = a.visitor_id GROUP BY 1",
    "s_filled": """SELECT visitor_id, item_id, n + i AS rank FROM (SELECT l.visitor_id, l.n, p.item_id, row_number() OVER (PARTITION BY l.visitor_id ORDER BY p.rank) AS i
        FROM s_lengths l CROSS JOIN popular p WHERE l.n < 10 AND p.item_id IN (FROM available)
        AND NOT EXISTS (SELECT 1 FROM s_history h WHERE h.visitor_id = l.visitor_id AND h.item_id = p.item_id)
        AND NOT EXISTS (SELECT 1 FROM s_ranked r WHERE r.visitor_id = l.visitor_id AND r.item_id = p.item_id)) WHERE n + i <= 10""",
    "served": """SELECT visitor_id, item_id, score, sources, CAST(rank AS BIGINT) AS rank, false AS filled FROM s_ranked
        UNION ALL SELECT visitor_id, item_id, 0.0, 'popularity', CAST(rank AS BIGINT), true FROM s_filled""",
    "s_used": "SELECT visitor_id, count(*) AS used FROM s_history GROUP BY 1",
    "s_short": "SELECT visitor_id, bool_or(filled) AS fallback_used FROM served GROUP BY 1",
    "gold_items": """SELECT item_id, coalesce(entries, MAP(CAST([] AS INTEGER[]), CAST([] AS DOUBLE[]))) AS item_feature_vector FROM catalog
        LEFT JOIN (SELECT item_id, map_from_entries(list((bucket, value) ORDER BY bucket)) AS entries FROM vectors GROUP BY 1) USING (item_id)""",
    "models": "SELECT unnest(['weighted_popularity', 'item_collaborative_filtering', 'content_similarity', 'item_cf_content_hybrid']) AS model",
    "lengths": "SELECT m.model, v.visitor_id, count(r.item_id) AS n FROM models m CROSS JOIN visitors v LEFT JOIN ranked r ON r.model = m.model AND r.visitor_id = v.visitor_id GROUP BY 1, 2",
    "filled": """SELECT model, visitor_id, item_id, n + i AS rank FROM (SELECT l.model, l.visitor_id, l.n, p.item_id,
          row_number() OVER (PARTITION BY l.model, l.visitor_id ORDER BY p.rank) AS i FROM lengths l CROSS JOIN popular p
          WHERE l.n < 10 AND NOT EXISTS (SELECT 1 FROM history h WHERE h.visitor_id = l.visitor_id AND h.item_id = p.item_id)
          AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.model = l.model AND r.visitor_id = l.visitor_id AND r.item_id = p.item_id)) WHERE n + i <= 10""",
    "recommended": "SELECT model, visitor_id, item_id, CAST(rank AS BIGINT) AS rank, false AS fallback FROM ranked UNION ALL SELECT model, visitor_id, item_id, CAST(rank AS BIGINT), true FROM filled",
    "relevant": """SELECT visitor_id, count(*) AS relevant, list_sum([1 / log2(i + 1) FOR i IN range(1, least(10, count(*)) + 1)]) AS ideal FROM targets GROUP BY 1""",
    "hits": "SELECT r.model, r.visitor_id, count(*) AS hits, sum(1 / log2(r.rank + 1)) AS dcg FROM recommended r JOIN targets t USING (visitor_id, item_id) GROUP BY 1, 2",
    "per_user": """SELECT m.model, v.visitor_id, coalesce(h.hits, 0) AS hits, coalesce(h.hits, 0) / 10.0::DOUBLE AS precision_, coalesce(h.hits, 0) / v.relevant::DOUBLE AS recall,
        coalesce(h.dcg, 0) / v.ideal AS ndcg, EXISTS (SELECT 1 FROM history x WHERE x.visitor_id = v.visitor_id) AS warm
        FROM models m CROSS JOIN relevant v LEFT JOIN hits h ON h.model = m.model AND h.visitor_id = v.visitor_id""",
    "segmented": "SELECT 'all' AS segment, * FROM per_user UNION ALL SELECT CASE WHEN warm THEN 'warm' ELSE 'cold' END, * FROM per_user",
    "shown": """SELECT model, segment, count(DISTINCT item_id) AS distinct_items, count(DISTINCT short) AS fallback_users FROM (
        SELECT model, item_id, CASE WHEN fallback AND model <> 'weighted_popularity' THEN visitor_id END AS short, unnest(['all', CASE WHEN EXISTS (SELECT 1 FROM history x WHERE x.visitor_id = r.visitor_id) THEN 'warm' ELSE 'cold' END]) AS segment FROM recommended r) GROUP BY 1, 2""",
    "metrics": """SELECT model, segment, count(*) AS evaluated_users, round(avg(precision_), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg,
        round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate,
        round(any_value(distinct_items) / (SELECT count(*) FROM available)::DOUBLE, 6) AS catalog_coverage, CAST(any_value(distinct_items) AS BIGINT) AS distinct_items, CAST(any_value(fallback_users) AS BIGINT) AS fallback_users
        FROM segmented JOIN shown USING (model, segment) GROUP BY 1, 2""",
}


def derived(prefix: str, names: str, instead: dict[str, str]) -> None:
    """Add the expressions of these names again, with a prefix, over each other and over what stands instead of some."""
    own = names.split()
    other = instead | {n: prefix + n for n in own}
    for name in own:
        CTES[prefix + name] = re.sub(r"\b(FROM|JOIN|,)(\s+)(\w+)\b", lambda m: m[1] + m[2] + other.get(m[3], m[3]), CTES[name])


# the feature layer's neighbours, from the whole timeline
derived("g_", "pairs norms directed neighbours", {"train": "gold", "capped": "gold_capped"})
# tuning: the same chain over a window of seven days before the cutoff
CTES["t_bounds"] = "SELECT cutoff_ms - 7 * 86400000 AS cutoff_ms, cutoff_ms AS end_ms FROM bounds"
derived("t_", "train popular", {"bounds": "t_bounds"})
CTES["t_targets"] = """SELECT DISTINCT e.visitor_id, e.item_id FROM silver e, t_bounds WHERE event_timestamp_ms >= cutoff_ms AND event_timestamp_ms < end_ms
        AND event_type = 'transaction' AND e.item_id IN (FROM available) AND e.visitor_id IN (SELECT visitor_id FROM t_train)
        AND NOT EXISTS (SELECT 1 FROM t_train t WHERE t.visitor_id = e.visitor_id AND t.item_id = e.item_id)"""
derived("t_", "visitors history capped pairs norms directed neighbours cf summed profile known category_share parent_share cosines content_dense relevant", {"train": "t_train", "targets": "t_targets"})
CTES |= {
    "grids": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(f'{x}::DOUBLE' for x in w)})" for i, w in enumerate(CONTENT_GRID)) + ") AS g(grid, vector_weight, category_weight, parent_weight)",
    "mixes": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {w}::DOUBLE, {round(1 - w, 10)}::DOUBLE)" for i, w in enumerate(ITEM_CF_GRID)) + ") AS m(mix, item_cf_weight, content_weight)",
    "trials": f"SELECT *, grid * {len(ITEM_CF_GRID)} + mix AS trial FROM grids CROSS JOIN mixes",
    "t_content": """SELECT * FROM (SELECT grid, visitor_id, item_id, row_number() OVER (PARTITION BY grid, visitor_id ORDER BY score DESC, item_id) AS content_rank FROM (
        SELECT grid, visitor_id, item_id, round(vector_weight * cosine + category_weight * category + parent_weight * parent, 9) AS score FROM t_content_dense CROSS JOIN grids)) WHERE content_rank <= 100""",
    "t_lists": "SELECT * FROM t_content FULL JOIN (SELECT grid, visitor_id, item_id, rank AS cf_rank FROM t_cf CROSS JOIN grids) USING (grid, visitor_id, item_id)",
    "t_ranked": """SELECT * FROM (SELECT trial, visitor_id, item_id, row_number() OVER (PARTITION BY trial, visitor_id ORDER BY score DESC, item_id) AS rank FROM (
        SELECT trial, visitor_id, item_id, round(coalesce(item_cf_weight / (20.0::DOUBLE + cf_rank), 0) + coalesce(content_weight / (20.0::DOUBLE + content_rank), 0), 9) AS score FROM t_lists JOIN trials USING (grid))) WHERE rank <= 10""",
    "t_lengths": "SELECT m.trial, v.visitor_id, count(r.item_id) AS n FROM trials m CROSS JOIN t_visitors v LEFT JOIN t_ranked r ON r.trial = m.trial AND r.visitor_id = v.visitor_id GROUP BY 1, 2",
    "t_filled": """SELECT trial, visitor_id, item_id, n + i AS rank FROM (SELECT l.trial, l.visitor_id, l.n, p.item_id, row_number() OVER (PARTITION BY l.trial, l.visitor_id ORDER BY p.rank) AS i
        FROM t_lengths l CROSS JOIN t_popular p WHERE l.n < 10 AND NOT EXISTS (SELECT 1 FROM t_history h WHERE h.visitor_id = l.visitor_id AND h.item_id = p.item_id)
        AND NOT EXISTS (SELECT 1 FROM t_ranked r WHERE r.trial = l.trial AND r.visitor_id = l.visitor_id AND r.item_id = p.item_id)) WHERE n + i <= 10""",
    "t_hits": "SELECT trial, visitor_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT trial, visitor_id, item_id, rank FROM t_ranked UNION ALL SELECT trial, visitor_id, item_id, rank FROM t_filled) JOIN t_targets USING (visitor_id, item_id) GROUP BY 1, 2",
    "tuned": """SELECT m.trial, round(avg(coalesce(hits, 0) / 10.0::DOUBLE), 9) AS "precision", round(avg(coalesce(hits, 0) / v.relevant::DOUBLE), 9) AS recall, round(avg(coalesce(dcg, 0) / v.ideal), 9) AS ndcg,
        round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS hit_rate
        FROM trials m CROSS JOIN t_relevant v LEFT JOIN t_hits h ON h.trial = m.trial AND h.visitor_id = v.visitor_id GROUP BY 1""",
}


def with_ctes(final: str, *names: str) -> str:
    """`final` after the expressions it needs: those named and all they may use."""
    wanted: set[str] = set()

    def need(name: str) -> None:
        if name in wanted:
            return
        wanted.add(name)
        for other in CTES:
            if other != name and _mentions(CTES[name], other):
                need(other)

    for name in names or [n for n in CTES if _mentions(final, n)]:
        need(name)
    if not wanted:
        return final
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in wanted)
    return f"WITH {parts}\n{final}"


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", sql) is not None
