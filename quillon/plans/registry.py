"""Every registered query by name."""

from __future__ import annotations

from quillon.plans import answers, audits, dashboards, generated, passthrough, questions, retrieval
from quillon.plans import samples, served
from quillon.plans import vector_queries as vq
from quillon.sources import catalog

QUERIES = {
    "sample_top_locations": samples.top_locations,
    "sample_avg_fare_by_passengers": samples.avg_fare_by_passengers,
    "sample_churn_by_region": samples.churn_by_region,
    "sample_tenure_buckets": samples.tenure_buckets,
    "sample_trips_per_month": samples.trips_per_month,
    "table_profile": catalog.table_profile,
    "guard_sql_keywords": audits.guard_sql_keywords,
    "sanitize_sql": audits.sanitize_sql,
    "check_query": audits.check_query,
    "redact_pii": audits.redact_pii,
    "validate_requests": audits.validate_requests,
    "recent_user_queries": audits.recent_user_queries,
    "bias_analyze": audits.bias_analyze,
    "bias_tool": audits.bias_tool,
    "ethics_report": audits.ethics_report,
    "bias_by_language": audits.bias_by_language,
    "dist_all_metrics": vq.dist_all_metrics,
    "knn_l2": vq.knn_by("l2"),
    "knn_cosine": vq.knn_by("cosine"),
    "knn_dot": vq.knn_by("dot"),
    "knn_manhattan": vq.knn_by("manhattan"),
    "knn_l2_large": vq.knn_large("l2", 64),
    "knn_manhattan_large": vq.knn_large("manhattan", 64),
    "knn_cosine_large": vq.knn_large("cosine", 128),
    "knn_mixed_metric": vq.knn_mixed_metric,
    "kmeans_assign_step": vq.kmeans_assign_step,
    "kmeans_update_step": vq.kmeans_update_step,
    "kmeans_l2": vq.kmeans_l2,
    "kmeans_cluster_rule": vq.kmeans_cluster_rule,
    "ivf_search_kept": vq.ivf_search_kept,
    "ivf_search": vq.ivf_search,
    "ivf_single_probe": vq.ivf_single_probe,
    "graph_edges": vq.graph_edges,
    "graph_edges_large": vq.graph_edges_large,
    "graph_search": vq.graph_search,
    "graph_search_large": vq.graph_search_large,
    "recall_by_method": vq.recall_by_method,
    "question_classify": questions.question_classify,
    "question_slots": questions.question_slots,
    "question_answers": questions.question_answers,
    "chart_specs": questions.chart_specs,
    "narratives": questions.narratives,
    "question_rows": questions.question_rows,
    "chart_values": questions.chart_values,
    "pool_embeddings": retrieval.pool_embeddings,
    "retrieve_docs": retrieval.retrieve_docs,
    "retrieve_docs_kept": retrieval.retrieve_docs_kept,
    "embed_with_encoder": retrieval.embed_with_encoder,
    "rag_prompts": retrieval.rag_prompts,
    "agent_answers": answers.agent_answers,
    "batch_groups": dashboards.batch_groups,
    "batch_stats": dashboards.batch_stats,
    "dashboard_totals": dashboards.dashboard_totals,
    "latency_histogram": dashboards.latency_histogram,
    "latency_percentiles": dashboards.latency_percentiles,
    "percentile_sketches": dashboards.percentile_sketches,
    "session_gauges": dashboards.session_gauges,
    "session_series": dashboards.session_series,
    "transcripts": dashboards.transcripts,
    "synthetic_trips": generated.synthetic_trips,
    "synthetic_customers": generated.synthetic_customers,
    "sql_text_functions": served.sql_text_functions,
    "sql_distance_functions": served.sql_distance_functions,
    "run_sql_guarded": served.run_sql_guarded,
    "run_sql_limit": served.run_sql_limit,
    "guarded_requests": served.guarded_requests,
    "session_history": served.session_history,
    "batch_groups_short": served.batch_groups_short,
    "brief_answers": served.brief_answers,
    "request_batches": served.request_batches,
    "served_requests": served.served_requests,
    "requests_once": served.requests_once,
    "request_results": served.request_results,
    "session_visits": served.session_visits,
    "trace_records": served.trace_records,
    **{name: passthrough.statement(name) for name in passthrough.STATEMENTS},
}
