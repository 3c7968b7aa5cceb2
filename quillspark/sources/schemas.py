"""Declared schemas of every table as DDL text (readers never infer)."""

# Application tables
USERS = (
    "id BIGINT, username STRING, role STRING, is_active BOOLEAN, "
    "ai_preferences MAP<STRING, STRING>, created_at TIMESTAMP_NTZ")
SESSIONS = ("id STRING, user_id BIGINT, title STRING, updated_at TIMESTAMP_NTZ")
MESSAGES = (
    "id BIGINT, session_id STRING, role STRING, content STRING, sources ARRAY<STRING>, "
    "is_helpful BOOLEAN, feedback_note STRING, created_at TIMESTAMP_NTZ")
KNOWLEDGE_DOCS = (
    "id BIGINT, filename STRING, chunk_count INT, parsed_content ARRAY<STRING>, "
    "upload_time TIMESTAMP_NTZ")
CHUNKS = ("doc_id BIGINT, chunk_idx INT, path STRING, clause STRING, text STRING")
GRAPH_NODES = ("node_id STRING, name STRING, category STRING")
GRAPH_EDGES = ("source_id STRING, target_id STRING, relation STRING")
TRIPLES = ("s STRING, cat_s STRING, r STRING, t STRING, cat_t STRING")
HOT_TOPICS = (
    "id BIGINT, topic_name STRING, keywords ARRAY<STRING>, hit_count BIGINT, "
    "representative_queries ARRAY<STRING>, created_at TIMESTAMP_NTZ")
QUIZ_QUESTIONS = (
    "id BIGINT, source_doc_id BIGINT, content STRING, options ARRAY<STRING>, "
    "correct_answer STRING, explanation STRING, difficulty INT, created_at TIMESTAMP_NTZ")
QUIZ_RECORDS = (
    "user_id BIGINT, question_id BIGINT, user_answer STRING, is_correct BOOLEAN, "
    "created_at TIMESTAMP_NTZ")
AI_CONFIGS = (
    "id BIGINT, config_type STRING, provider_name STRING, base_url STRING, model_name STRING, "
    "is_active BOOLEAN")
CACHE_ENTRIES = (
    "key STRING, vector ARRAY<DOUBLE>, answer STRING, sources ARRAY<STRING>, ts TIMESTAMP_NTZ")
FRAMES = ("stream_id STRING, seq BIGINT, type STRING, data STRING")

TABLES = {
    "users": USERS,
    "chat_sessions": SESSIONS,
    "chat_messages": MESSAGES,
    "knowledge_docs": KNOWLEDGE_DOCS,
    "chunks": CHUNKS,
    "graph_nodes": GRAPH_NODES,
    "graph_edges": GRAPH_EDGES,
    "hot_topics": HOT_TOPICS,
    "quiz_questions": QUIZ_QUESTIONS,
    "user_quiz_records": QUIZ_RECORDS,
    "ai_configs": AI_CONFIGS,
    "cache_entries": CACHE_ENTRIES,
    "frames": FRAMES,
}

# JSON payloads found inside text
TRIPLE_JSON = "array<struct<s:string,cat_s:string,r:string,t:string,cat_t:string>>"
TOPIC_JSON = "struct<topic_name:string,keywords:array<string>>"
QUIZ_JSON = "struct<content:string,options:array<string>,correct_answer:string,explanation:string>"
FRAME_JSON = "struct<type:string,data:string,message_id:bigint>"

# Given test tables
INPUTS = {
    "documents": (
        "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"),
    "conversations": ("conv_id BIGINT, turn BIGINT, role STRING, text STRING"),
    "embeddings": ("vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"),
    "benchmark": ("item_id BIGINT, text STRING"),
    "labels": ("doc_id BIGINT, quality INT, toxic INT"),
    "pages": ("page_id BIGINT, url STRING, html STRING"),
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"),
    "supplier": (
        "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
    "nation": ("n_nationkey INT, n_name STRING, n_regionkey INT"),
    "region": ("r_regionkey INT, r_name STRING"),
}
