"""Subscription-revenue analytics as plain DataFrame -> DataFrame operators."""

from revspan.functions.calendar import Calendar
from revspan.plans.suite import METRICS, MetricSuite, Tables

__all__ = ["Calendar", "METRICS", "MetricSuite", "Tables"]
