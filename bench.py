"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from quillspark.plans import catalog
from quillspark.session import build_session, drop_written

HEADLINE = """
    top_users tokens_7d cache_hit_rate quiz_user_stats history_last8 history_sessions
    assemble_answer strict_clean tokenize chunk_fixed chunk_build chunk_recursive md_sections
    heading_path postings bm25_stats bm25_top20 knn_l2_top40 knn_ivf hybrid_candidates
    rerank_or_fallback context_block semantic_cache_lookup cache_split triples_valid graph_nodes
    graph_edges graph_links graph_context quiz_build daily_quiz grade_answers topic_rows
    kmeans_topics upsert_last_wins apply_feedback delete_session_cascade dedup_by_md5
""".split()


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{
        "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{root}/documents.parquet").count()  # JVM warm-up
    queries = catalog.queries()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(root)}))
    drop_written(spark)
    spark.stop()


if __name__ == "__main__":
    main()
