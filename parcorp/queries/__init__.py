"""All registered queries on the given tables."""

from parcorp.queries import cleaning, corpus, files, incremental, ingest, records, sequences, signs, stream  # noqa: F401
from parcorp.queries.registry import ORACLES, QUERIES  # noqa: F401
