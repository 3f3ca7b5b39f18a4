"""Declared schemas of the five source tables, their keys and references.

The column names, order and types are fixed by the CSV files they describe.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    BooleanType, DateType, DecimalType, IntegerType, StringType, StructField, StructType,
    TimestampNTZType,
)

_TEXT, _DAY, _INT, _FLAG = StringType(), DateType(), IntegerType(), BooleanType()
_MONEY, _MOMENT = DecimalType(12, 2), TimestampNTZType()


def _columns(*columns: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns])


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: StructType
    primary_key: str
    not_null: tuple[str, ...]
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    surrogate_key: str | None = None
    surrogate_order: tuple[str, ...] = ()
    has_free_text: bool = False


ACCOUNTS = TableSpec(
    "accounts",
    _columns(
        ("account_id", _TEXT), ("account_name", _TEXT), ("industry", _TEXT), ("country", _TEXT),
        ("signup_date", _DAY), ("referral_source", _TEXT), ("plan_tier", _TEXT), ("seats", _INT),
        ("is_trial", _FLAG), ("churn_flag", _FLAG),
    ),
    "account_id", ("account_name", "signup_date"),
)

SUBSCRIPTIONS = TableSpec(
    "subscriptions",
    _columns(
        ("subscription_id", _TEXT), ("account_id", _TEXT), ("start_date", _DAY),
        ("end_date", _DAY), ("plan_tier", _TEXT), ("seats", _INT), ("mrr_amount", _MONEY),
        ("arr_amount", _MONEY), ("is_trial", _FLAG), ("upgrade_flag", _FLAG),
        ("downgrade_flag", _FLAG), ("churn_flag", _FLAG), ("billing_frequency", _TEXT),
        ("auto_renew_flag", _FLAG),
    ),
    "subscription_id", ("account_id", "start_date"), {"account_id": ("accounts", "account_id")},
)

FEATURE_USAGE = TableSpec(
    "feature_usage",
    _columns(
        ("usage_id", _TEXT), ("subscription_id", _TEXT), ("usage_date", _DAY),
        ("feature_name", _TEXT), ("usage_count", _INT), ("usage_duration_secs", _INT),
        ("error_count", _INT), ("is_beta_feature", _FLAG),
    ),
    "usage_pk", ("usage_id", "subscription_id", "usage_date"),
    {"subscription_id": ("subscriptions", "subscription_id")}, surrogate_key="usage_pk",
    surrogate_order=("usage_date", "subscription_id", "usage_id"),
)

SUPPORT_TICKETS = TableSpec(
    "support_tickets",
    _columns(
        ("ticket_id", _TEXT), ("account_id", _TEXT), ("submitted_at", _MOMENT),
        ("closed_at", _MOMENT), ("resolution_time_hours", DecimalType(10, 2)),
        ("priority", _TEXT), ("first_response_time_minutes", _INT),
        ("satisfaction_score", DecimalType(2, 1)), ("escalation_flag", _FLAG),
    ),
    "ticket_id", ("account_id", "submitted_at"), {"account_id": ("accounts", "account_id")},
)

CHURN_EVENTS = TableSpec(
    "churn_events",
    _columns(
        ("churn_event_id", _TEXT), ("account_id", _TEXT), ("churn_date", _DAY),
        ("reason_code", _TEXT), ("refund_amount_usd", _MONEY),
        ("preceding_upgrade_flag", _FLAG), ("preceding_downgrade_flag", _FLAG),
        ("is_reactivation", _FLAG), ("feedback_text", _TEXT),
    ),
    "churn_event_id", ("account_id", "churn_date"), {"account_id": ("accounts", "account_id")},
    has_free_text=True,
)

TABLES = {
    spec.name: spec
    for spec in (ACCOUNTS, SUBSCRIPTIONS, FEATURE_USAGE, SUPPORT_TICKETS, CHURN_EVENTS)
}
