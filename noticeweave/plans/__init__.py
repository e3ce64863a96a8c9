"""Queries over the driver's tables, by family."""

from noticeweave.plans import analytics, days, detected, extras, imported, inbox, ledgers, links, markup, places, scopes, structures, texts
from noticeweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "days", "detected", "extras", "imported", "inbox", "ledgers", "links", "markup", "places", "scopes", "structures", "texts"]
