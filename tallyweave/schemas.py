"""Table schemas and the rule seed, as data."""

SLIPS = "id string, slip_reference string, ballot_type string, election_name string, province string, municipality string, voting_district string, station_name string, registered_voters int, status string, presiding_officer_name string, presiding_officer_signature_detected boolean, total_valid_votes int, total_spoilt_votes int, total_votes_cast int, special_votes int, section_24a_votes int, total_expected_pages int, total_received_pages int, is_vote_related boolean, created_at timestamp, updated_at timestamp, approved_at timestamp, approved_by string, rejection_reason string, processing_started_at timestamp, processing_ended_at timestamp"
PAGES = "id string, slip_id string, page_number int, page_total int, barcode_text string, raw_file_path string, enhanced_file_path string, thumbnail_path string, status string, upload_timestamp timestamp, file_size bigint, mime_type string, exception_flags array<string>"
PARTY_RESULTS = "id string, slip_id string, page_id string, row_index int, party_name string, party_code string, votes int, confidence_score double, is_overridden boolean, overridden_by string, original_ocr_votes int, signature_detected boolean, bbox struct<x:int,y:int,width:int,height:int>"
AUDIT = "id string, slip_id string, page_id string, user_id string, action string, field_name string, old_value string, new_value string, reason string, ip_address string, timestamp timestamp"
RULES = "rule_code string, is_active boolean, severity string, tolerance double, warning_pct double, max_pct double"
PAGE_RECORDS = "ingest_seq bigint, slip_reference string, voting_district string, ballot_type string, page_number int, page_total int, is_vote_related boolean"

#: The rules, their severities and thresholds.
RULE_SEED = [
    ("SUM_PARTY_VOTES_MATCH", True, "error", 0.0, None, None),
    ("RECONCILIATION_MATCH", True, "error", None, None, None),
    ("TURNOUT_CEILING", True, "error", None, 90.0, 100.0),
    ("VOTES_WITHIN_REGISTERED", True, "error", None, None, None),
    ("ALL_PAGES_PRESENT", True, "error", None, None, None),
    ("OFFICER_SIGNATURE_PRESENT", True, "warning", None, None, None),
    ("DUPLICATE_VD_BALLOT", True, "error", None, None, None),
    ("PARTY_SIGNATURE_CONSISTENCY", True, "warning", None, None, None),
]
STATUSES = ("incomplete", "pending_review", "approved", "rejected", "flagged")
EXTENSIONS = (".jpg", ".jpeg", ".png", ".pdf")
#: The first users.
USERS = "id string, username string, role string"
USER_SEED = [("usr_operator", "operator", "operator"), ("usr_reviewer", "reviewer", "reviewer"), ("usr_admin", "admin", "admin")]
