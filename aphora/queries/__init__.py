"""All registered queries."""

from aphora.queries import engagement, events, profiles, quality, streams, texts  # noqa: F401
from aphora.queries.registry import QUERIES, full_sql  # noqa: F401
