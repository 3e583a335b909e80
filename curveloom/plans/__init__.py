"""Queries over the test tables, with the SQL that gives the same rows."""

#: Modules whose QUERIES and SQL make up the catalogue.
MODULES = ["curveloom.sources.delimited", "curveloom.plans.catalog"]
