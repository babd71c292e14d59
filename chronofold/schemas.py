"""Stored tables; the order of columns is part of the contract, and every column may be null."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from "name type, name type", without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


TABLES: dict[str, T.StructType] = {
    "urls": struct(
        "url_id string, original_url string, canonical_url string, domain string, tld string, url_type string, entry_cohort string, first_observed string"
    ),
    "observations": struct(
        "url_id string, observer string, observation_time timestamp, query_time timestamp, status string, http_status int, error_class string, redirect_target string, "
        "mime_type string, content_length bigint, content_digest string, response_digest string, confidence double"
    ),
    "captures": struct(
        "url_id string, archive string, capture_time timestamp, memento_url string, mime_type string, status string, digest string, warc_file string, record_id string, "
        "query_status string, content_length bigint"
    ),
    "events": struct(
        "url_id string, event_type string, event_start timestamp, event_end timestamp, confidence double, evidence_count int, witness_count int, archive string"
    ),
}
#: The log behind the checkpoint view: one row for each mark, nothing is updated in place.
CHECKPOINT_LOG = struct("url_id string, witness string, state string, inc int, error_class string, seq bigint, updated_at timestamp")
ESTABLISHED = struct("archive string, established_year int")
CAPTURE = T.StructType([f for f in TABLES["captures"] if f.name not in ("url_id", "archive")])
REGISTRY = struct(
    "id string, name string, rate_limited boolean, cdx_endpoint string, cdx_access string, timemap_endpoint string, timemap_access string, "
    "established int, default_collection string, collections strings"
)

# The closed vocabularies.
ALIVE, RESTRICTED, GONE = "S0_observed_alive", "access_restricted", "terminal_inaccessible"
SERVER_ERROR, OTHER, NO_EVIDENCE, UNRESOLVED = "server_error", "other_response", "no_evidence_this_query", "unresolved"
ERROR_CLASSES = ("timeout", "rate_limited", "server_error", "connection_error", "dns_failure", "malformed_response", "client_error", "not_found")
SUCCESS, RETRY, FAILED, SKIPPED, RESET = "SUCCESS", "RETRY", "PERMANENT_FAILURE", "SKIPPED_EARLY_STOP", "RESET"
TERMINAL_CODES = (204, 400, 404, 410, 500, 501, 502, 503, 523)
LIVE = "live_web"
#: Witnesses that confirm a disappearance, and the ratio of lengths below which content was replaced.
THRESHOLD, REPLACED_BELOW = 2, 0.5
