"""All registered queries and their SQL."""

from . import extract_queries, media_queries, ranking_queries, roundtrip_queries, snapshot_queries, stream_queries, url_text, usage_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
