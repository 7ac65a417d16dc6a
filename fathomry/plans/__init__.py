"""The registered queries. Importing this package registers those of all its modules."""

from . import comparison, curation, features, ingest, packed, papers, payloads, reports, similarity, streams  # noqa: F401
