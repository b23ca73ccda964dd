"""Schemas of the tables that document pipelines keep."""

from pyspark.sql.types import StructType

_STAMPS = "created_at timestamp, updated_at timestamp, user_id string, workspace_id string"

MAP_DOCUMENTS = f"document_id string, source_url string, source_type string, doc_type string, platform string, discovery_method string, discovery_url string, status string, is_new boolean, title string, content_hash string, error string, metadata_json string, {_STAMPS}"
FETCH_DOCUMENTS = f"document_id string, doc_type string, platform string, status string, content_length int, content_hash string, content_path string, fetch_engine string, public_url string, error string, metadata_json string, embedding binary, {_STAMPS}"
PROFILES = f"id bigint, platform string, platform_id string, username string, display_name string, bio string, followers_count int, following_count int, posts_count int, profile_url string, avatar_url string, verified boolean, raw_metadata string, {_STAMPS}"
POSTS = f"id bigint, platform string, platform_id string, profile_id bigint, content_text string, content_html string, media_urls array<string>, likes_count int, shares_count int, comments_count int, published_at string, raw_metadata string, {_STAMPS}"
DOCUMENT_IDS = "document_id string, url string, url_hash string, source_type string"
WORKFLOW_RUNS = f"id string, workflow string, status string, started_at timestamp, completed_at timestamp, error string, inputs string, metadata_json string, {_STAMPS}"
STEP_LOGS = f"id string, run_id string, step_id string, tool string, status string, started_at timestamp, completed_at timestamp, input_count int, output_count int, error_count int, errors string, metadata_json string, {_STAMPS}"
STEP_EVENTS = "id bigint, run_id string, step_id string, substep string, status string, created_at timestamp, current int, total int, message string, metadata_json string"
LLM_TRACES = f"id string, workflow_id string, step_name string, model string, provider string, prompt string, response string, structured_output string, input_tokens int, output_tokens int, total_tokens int, cost double, latency_ms int, error string, retry_count int, {_STAMPS}"
SIGNALS = "id string, signal_id string, source string, title string, url string, snippet string, author string, score int, comment_count int, subreddit string, domain string, keywords_json array<string>, signal_timestamp string"
RESEARCH = "id string, query string, answer string, source string, model string, citations_json string, response_time_seconds double, status string, error string, content_path string"
ANALYTICS_DOMAINS = "domain string, platform string, has_data boolean, last_synced_at timestamp, sync_period_days int, status string, error string"
PAGE_ANALYTICS = (
    "id string, url string, domain string, pageviews_60d int, pageviews_30d int, pageviews_previous_30d int, unique_visitors_60d int, unique_visitors_30d int, unique_visitors_previous_30d int, "
    "avg_session_duration_seconds double, bounce_rate double, pageviews_trend string, trend_percentage double, period_start timestamp, period_end timestamp, synced_at timestamp"
)
EMBEDDINGS = "id string, document_id string, workflow_id string, model string, provider string, vector_size int, status string, text_hash string, text_length int, error string, embedding binary"
ROW_ERRORS = "row_idx bigint, error_type string, message string, details map<string,string>"

TABLES: dict[str, str] = {
    "map_documents": MAP_DOCUMENTS, "fetch_documents": FETCH_DOCUMENTS, "profiles": PROFILES, "posts": POSTS, "document_id_registry": DOCUMENT_IDS, "workflow_runs": WORKFLOW_RUNS,
    "step_logs": STEP_LOGS, "step_events": STEP_EVENTS, "llm_traces": LLM_TRACES, "monitoring_signals": SIGNALS, "research_documents": RESEARCH, "analytics_domains": ANALYTICS_DOMAINS,
    "page_analytics": PAGE_ANALYTICS, "batch_embedding_records": EMBEDDINGS,
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
