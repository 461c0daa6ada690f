"""All registered queries and their DuckDB oracle SQL."""

from __future__ import annotations

from turnstile.plans import chat_documents, conversations, documents, node_rules, pages, planted, roundtrip, structure


def _modules():
    return [conversations, roundtrip, pages, documents, planted, chat_documents, structure, node_rules]


def queries():
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update({k: v for k, v in m.ORACLE.items() if k in m.QUERIES})
    return out


def flagship(spark, sf_dir):
    return roundtrip.rt_data_attr(spark, sf_dir)
