"""Every operator as a query over the test tables, with its SQL counterpart."""

from foldwise.catalog import (  # noqa: F401  (importing registers the queries)
    column_queries,
    encode_queries,
    evaluate_queries,
    media_queries,
    order_queries,
    profile_queries,
    source_queries,
    split_queries,
)
from foldwise.catalog.registry import QUERIES, SQL  # noqa: F401
