"""Fixed schemas of captures, comment rows and audits."""

from __future__ import annotations

CAPTURE_TAG = "instagram_visible_capture_v1"
COMMENT_TAG = "instagram_comment_v1"

COMMENT = "struct<comment_id:string,parent_comment_id:string,depth:int,author:string,comment_text:string,published_at:string,published_label:string,like_count:string,comment_url:string,semantic:struct<tier:string,score:double,evidence_terms:array<string>,reason:string>>"
DISCOVERY = "struct<matched_asins:array<string>,matched_queries:array<string>,relevance_tier:string,relevance_score:double,evidence_terms:array<string>,deliverable_eligible:boolean,shortcode_mismatch_count:int,discovery_url:string,discovery_media_type:string>"
LEDGER = "struct<round:int,pass:int,label:string,action:string,wait_ms:bigint,at:string>"
CAPTURE = (
    "schema_version string, captured_at string, "
    f"media struct<media_url:string,media_id:string,owner:string,discovery:{DISCOVERY}>, "
    "page struct<status:string,coverage:string,identity_verified:boolean,visible_comment_count:int,remaining_expand_controls:int,platform_comment_count:int,shortcode_mismatch_count:int,actual_shortcode:string,observed_shortcodes:array<string>>, "
    f"comments array<{COMMENT}>, "
    f"continuous_scroll struct<round_count:int,expand_action_count:int,scroll_action_count:int,attempt_count:int,stop_reason:string,expanded_thread_signatures:array<string>,scroll_frontier:map<string,string>,action_ledger:array<{LEDGER}>>, "
    "navigation struct<requested_url:string,rendered_url:string,working_media_url:string,requested_media_type:string,rendered_media_type:string,route_fallback_attempt_count:int,route_fallback_success_count:int>"
)
#: Columns of a raw comment row, in export order (fixed values).
RAW_COMMENT = (
    "schema_version string, platform string, record_type string, amazon_asins array<string>, matched_query string, matched_queries array<string>, "
    "media_id string, shortcode string, media_type string, media_url string, post_url string, media_owner string, comment_id string, "
    "media_relevance_tier string, media_relevance_score double, media_evidence_terms array<string>, parent_comment_id string, source_parent_id string, "
    "depth int, author string, username string, comment_text string, comment_relevance_tier string, comment_relevance_score double, "
    "comment_evidence_terms array<string>, published_at string, timestamp string, published_label string, like_count string, likes string, "
    "comment_url string, captured_at string, field_warnings array<string>"
)
RAW_FIELDS = [part.strip().split(" ")[0] for part in RAW_COMMENT.split(",") if " " in part.strip()]
#: Columns of the exported media audit, in order (fixed values).
AUDIT_FIELDS = [
    "media_id", "media_type", "media_url", "discovery_media_type", "discovery_url", "requested_media_type", "requested_url",
    "rendered_media_type", "rendered_url", "working_media_url", "route_fallback_attempt_count", "route_fallback_success_count",
    "media_owner", "relevance_tier", "relevance_score", "evidence_terms", "evidence_sources", "matched_groups", "group_hits",
    "relevance_reason", "relevance_model_version", "deliverable_eligible", "collection_status", "audit_status", "page_status",
    "platform_comment_count", "captured_rows", "main_comment_rows", "reply_rows", "final_unique_comment_count",
    "shortcode_mismatch_count", "expand_action_count", "scroll_round_count", "scroll_action_count", "remaining_expand_controls",
    "stop_reason", "reason",
]
#: Columns of the exported candidate audit, in order (fixed values).
CANDIDATE_FIELDS = [
    "shortcode", "media_type", "url", "discovery_media_type", "discovery_url", "requested_media_type", "requested_url",
    "rendered_media_type", "rendered_url", "working_media_url", "route_fallback_attempt_count", "route_fallback_success_count",
    "owner", "caption", "hashtags", "matched_queries", "matched_asins", "relevance_tier", "relevance_score", "evidence_terms",
    "evidence_sources", "relevance_model_version", "matched_groups", "group_hits", "deliverable_eligible", "decision",
    "audit_status", "page_status", "platform_comment_count", "main_comment_rows", "reply_rows", "expand_action_count",
    "scroll_round_count", "scroll_action_count", "retry_count", "stop_reason", "last_retry_error", "actual_shortcode",
    "shortcode_mismatch_count",
]
PRODUCT = (
    "asin string, title string, product_title string, brand string, category string, product_type string, product_name string, bullets array<string>, functions array<string>, "
    "use_scenarios array<string>, pain_points array<string>, ingredients array<string>, aliases array<string>, competitors array<string>, source_status string, source_url string, "
    "core_attributes array<string>, primary_functions array<string>, use_cases array<string>, problems array<string>, ingredients_or_components array<string>, common_names array<string>, competitor_products array<string>"
)
