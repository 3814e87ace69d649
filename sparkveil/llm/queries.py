"""Queries of the training-data operators and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from . import decontaminate, langid, licenses, media, mixing, near, private, shards, substrings, urls

QUERIES = {"op1_mixing": mixing.query, "op2_near": near.query, "op3_urls": urls.query, "op4_private": private.query, "op5_licenses": licenses.query, "op6_language": langid.query, "op7_substrings": substrings.query, "op8_shards": shards.query, "op9_decontaminate": decontaminate.query, "op10_media": media.query, "url_rules": urls.rules_query}
ORACLES = {"url_rules": urls.RULES_ORACLE, "op7_substrings": substrings.ORACLE, "op8_shards": shards.ORACLE, "op9_decontaminate": decontaminate.ORACLE}
