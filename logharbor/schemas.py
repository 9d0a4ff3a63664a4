"""Table and record schemas, as DDL strings."""

LOG_ENTRIES = (
    "id string, session_id string, timestamp timestamp, level string, source string, "
    "service string, message string, raw_line string, extra_fields map<string,string>, "
    "is_anomaly boolean, anomaly_score double, cluster_id string, incident_id string, "
    "created_at timestamp"
)
CLUSTERS = (
    "id string, name string, description string, centroid_vector_id string, log_count int, "
    "severity string, representative_messages array<string>, tags array<string>, "
    "first_seen timestamp, last_seen timestamp, created_at timestamp, updated_at timestamp"
)
ROOT_CAUSE = "struct<cause:string,confidence:double,category:string>"
TIMELINE_EVENT = "struct<timestamp:timestamp,event:string,level:string,service:string>"
INCIDENTS = (
    "id string, title string, description string, severity string, status string, "
    f"cluster_id string, root_causes array<{ROOT_CAUSE}>, recommended_fixes array<string>, "
    f"timeline array<{TIMELINE_EVENT}>, ai_confidence double, ai_summary string, "
    "affected_services array<string>, log_count int, detected_at timestamp, "
    "resolved_at timestamp, created_at timestamp, updated_at timestamp"
)
LOG_EMBEDDINGS = (
    "id string, log_entry_id string, chroma_id string, model_name string, "
    "embedding_dimension int, embedding array<float>, created_at timestamp"
)
ALERTS = (
    "id string, incident_id string, alert_type string, title string, message string, "
    "severity string, status string, threshold_value double, actual_value double, "
    "alert_metadata map<string,string>, fired_at timestamp, resolved_at timestamp, "
    "created_at timestamp"
)
INCIDENT_SUMMARIES = (
    "id string, incident_id string, executive_summary string, technical_details string, "
    "impact_assessment string, prevention_steps array<string>, "
    "similar_past_incidents array<struct<incident_id:string,distance:double,document:string>>, "
    "model_used string, token_usage int, generated_at timestamp"
)
INGESTION_SESSIONS = (
    "id string, source string, filename string, total_lines int, processed_lines int, "
    "error_lines int, status string, started_at timestamp, completed_at timestamp, "
    "created_at timestamp"
)

# Replies of the caller's model.
RAW_CAUSES = "array<struct<cause:string,confidence:string,category:string>>"
ROOT_CAUSE_REPLY = (
    f"root_causes {RAW_CAUSES}, "
    "recommended_fixes array<string>, ai_confidence string, executive_summary string, "
    "technical_details string, impact_assessment string, prevention_steps array<string>"
)
TIMELINE_REPLY = (
    "timeline array<struct<timestamp:string,event:string,level:string,service:string>>, "
    "chain_summary string"
)
