"""Queries over the given tables, each with the SQL that must give the same rows."""


def all_checks():
    from checks import convert, corpus, events, ingest, scan, text_search, trees  # noqa: F401
    from checks.tables import ORACLES, QUERIES

    return QUERIES, ORACLES
