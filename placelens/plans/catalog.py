"""All queries of the place engine by name, with the SQL that states the same result."""

from . import catalogue, discovery, insights, learning, people, quality, requests, views

PARTS = (catalogue, discovery, insights, learning, people, quality, requests, views)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
