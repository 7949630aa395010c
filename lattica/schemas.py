"""Declared schemas of the engine's tables."""

_SOURCE = "struct<document_id:string,page:int,section:string,offset:bigint,confidence:double>"
_ACL = "access_level string, owner_id string, department string, required_roles array<string>, allowed_users array<string>"

TABLES = {
    "documents": (
        f"document_id string, title string, file_path string, file_type string, file_size bigint, file_hash string, {_ACL}, "
        "metadata map<string,string>, created_at timestamp, updated_at timestamp, processed_at timestamp, deleted_at timestamp"
    ),
    "chunks": (
        "document_id string, chunk_index bigint, content string, content_hash string, start_offset bigint, end_offset bigint, "
        "page int, section string, vector_id string"
    ),
    "vectors": f"id string, document_id string, chunk_index bigint, content string, vector array<float>, {_ACL}",
    "mentions": "document_id string, start bigint, end bigint, text string, entity_type string, confidence double",
    "relations": (
        "document_id string, subject string, subject_type string, subject_start bigint, subject_end bigint, predicate string, "
        "object string, object_type string, object_start bigint, object_end bigint, confidence double"
    ),
    "nodes": (
        "node_id string, class string, text string, properties map<string,string>, document_id string, confidence double"
    ),
    "edges": f"src string, predicate string, dst string, confidence double, source {_SOURCE}, created_at timestamp",
    "extraction_queue": (
        "extraction_id string, document_id string, extracted_entities string, extracted_relations string, source_text string, "
        "confidence double, status string, priority bigint, reviewer_id string, review_notes string, reviewed_at timestamp, created_at timestamp"
    ),
    "decisions": (
        "extraction_id string, decision_id string, action string, reviewer string, reason string, notes string, "
        "corrected_entity string, corrected_relation string, reviewed_at timestamp"
    ),
    "acl_users": "user_id string, email string, display_name string, roles array<string>, departments array<string>, is_internal boolean",
    "auth_users": (
        "user_id string, email string, name string, password_hash string, role string, department string, is_active boolean, "
        "failed_login_attempts bigint, locked_until timestamp, last_login timestamp, created_at timestamp"
    ),
    "refresh_tokens": "jti string, user_id string, token_hash string, expires_at timestamp, revoked_at timestamp, created_at timestamp",
    "token_blacklist": "jti string, user_id string, expires_at timestamp, reason string",
    "audit_log": (
        "at timestamp, event_type string, user_id string, email string, success boolean, reason string, role string, resource string, "
        "required_role string, failed_attempts bigint, locked_until timestamp, logout_all_devices boolean, unlocked_by string, "
        "ip_address string, user_agent string"
    ),
    "query_stats": (
        "query_id string, user_id string, query_text string, total_ms bigint, vector_ms bigint, graph_ms bigint, llm_ms bigint, "
        "num_results bigint, top_score double, confidence double, filters string, created_at timestamp"
    ),
    "hits": f"request_id string, result_type string, hit_id string, content string, score double, source {_SOURCE}, {_ACL}",
}
