"""Registered queries over the driver tables and the SQL that must give the same rows."""
from touchline.catalog.base import QUERIES, SQL  # noqa: F401
from touchline.catalog import (aggregates, functions, gold, ingestion, joins, movement, tables, tracks, windows)  # noqa: F401,E402
