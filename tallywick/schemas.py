"""Explicit schemas of all layers, and the fixed values of the domain."""

from __future__ import annotations

# Event types with their weights, targets, model defaults.
WEIGHTS = {"view": 1, "addtocart": 3, "transaction": 5}
TARGET_EVENTS = {"transaction": ("transaction",), "high-intent": ("addtocart", "transaction")}
CONTENT_WEIGHTS = {"vector_weight": 0.80, "category_weight": 0.15, "parent_weight": 0.05}
HYBRID_WEIGHTS = CONTENT_WEIGHTS | {"item_cf_weight": 0.60, "content_weight": 0.40, "rrf_constant": 20.0}
CONTENT_GRID = ((1.00, 0.00, 0.00), (0.90, 0.075, 0.025), (0.80, 0.15, 0.05), (0.70, 0.20, 0.10), (0.60, 0.25, 0.15))
ITEM_CF_GRID = tuple(i / 10 for i in range(11))
DAY_MS = 86_400_000


#: DDL of the tables that are written by these types and checked by these ordered names (ingest_seq stands for the row order of the store).
SCHEMAS = {
    "bronze_events": "timestamp bigint, visitorid bigint, event string, itemid bigint, transactionid bigint",
    "bronze_item_properties": "timestamp bigint, itemid bigint, property string, value string, ingest_seq bigint",
    "bronze_category_tree": "categoryid bigint, parentid bigint",
    "silver_user_events": "event_timestamp string, visitor_id bigint, item_id bigint, event_type string, transaction_id bigint, event_timestamp_ms bigint",
    "silver_products": "item_id bigint, category_id bigint, available bigint, encoded_properties array<string>",
    "silver_category_hierarchy": "category_id bigint, parent_category_id bigint",
    "gold_user_item_features": "visitor_id bigint, item_id bigint, view_count bigint, cart_count bigint, purchase_count bigint, interaction_score bigint, last_interaction_timestamp string",
    "gold_item_features": "item_id bigint, category_id bigint, parent_category_id bigint, available bigint, item_feature_vector map<int,double>",
}
CHECKED_SCHEMAS = {name: [column.split()[0] for column in ddl.split(", ")] for name, ddl in SCHEMAS.items()}
