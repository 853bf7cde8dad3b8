"""Explicit schemas; nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

FINDING = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("redaction_tag", T.StringType()),
        T.StructField("dpdp_category", T.StringType()),
    ]
)
FINDINGS = T.ArrayType(FINDING)

LEDGER = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("actor_hash", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("user_role", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("prompt_hash", T.StringType()),
        T.StructField("redactions_applied", T.ArrayType(T.StringType())),
        T.StructField("policy_triggered", T.StringType()),
        T.StructField("model_queried", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("prev_hash", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("entry_hash", T.StringType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("dept", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("entity_types", T.ArrayType(T.StringType())),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("enforcement", T.StringType()),
        T.StructField("risk_threshold", T.DoubleType()),
        T.StructField("allowed_models", T.ArrayType(T.StringType())),
        T.StructField("departments", T.ArrayType(T.StringType())),
    ]
)

SHADOW_DETECTION = "timestamp string, domain string, tool_name string, vendor string, risk string, detected_by string, action string"
CONSENT = (
    "consent_id string, principal_hash string, purpose string, purpose_description string, granted boolean, "
    "channel string, timestamp string, expires_at string, revoked boolean, revoked_at string, revoke_reason string, "
    "metadata string"
)
INCIDENT = (
    "report_id string, timestamp string, organization string, incident_type string, "
    "affected_data_types array<string>, estimated_records bigint, description string, "
    "notification_due_by string, status string, dpdp_section string"
)
PRINCIPAL_REQUEST = (
    "timestamp string, principal_id_hash string, request_type string, details string, filed_by string, "
    "status string, sla_deadline string, request_id string"
)
LICENSE = (
    "license_key string, license_id string, organization string, email string, plan string, deployment_mode string, "
    "hardware_id string, seats_total int, seats_used int, issued_at string, expires_at string, is_active boolean, "
    "activated_at string, activations array<struct<hardware_id:string,organization:string,activated_at:string>>"
)
WEBHOOK_DELIVERY = (
    "hook_id string, target_url string, body string, headers map<string,string>, reason string, attempts int, "
    "queued_at string"
)
