"""All queries but those of the corpus operators."""

from marginalia.plans import aggregates, chunks, joins, records, retrieval, routing, scans, streams, texts  # noqa: F401
from marginalia.plans.catalog import QUERIES, SQL  # noqa: F401
