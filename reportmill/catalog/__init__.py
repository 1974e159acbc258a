"""Registered queries: name → (query, SQL form or None)."""


def registered() -> dict:
    from reportmill.catalog import ingest, landed, reads, texts

    return {**reads.QUERIES, **texts.QUERIES, **ingest.QUERIES, **landed.QUERIES}
