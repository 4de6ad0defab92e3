"""Registered queries: the library's operators over the test tables, each with the SQL that
recomputes it. ``QUERIES`` maps a name to ``(function of (spark, folder), SQL or None)``."""

from catalogue import code, dates, documents, fleet, manifests, streams, whole

QUERIES = {
    **documents.QUERIES, **code.QUERIES, **manifests.QUERIES, **dates.QUERIES,
    **fleet.QUERIES, **streams.QUERIES, **whole.QUERIES,
}
