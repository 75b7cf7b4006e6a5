"""Queries of the training-data operators, and SQL for those that SQL can express."""

from . import chat_format, conversation_repair, decontaminate, fill_in_middle, html_extract, license_scan, ngram_join, packing, pii, quality_classifier, quality_rules, suffix_dedup, url_filters

_MODULES = [quality_rules, quality_classifier, packing, url_filters, decontaminate, pii, ngram_join, suffix_dedup, html_extract, license_scan, fill_in_middle, chat_format, conversation_repair]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in getattr(m, "ORACLE_SQL", {}).items()}
