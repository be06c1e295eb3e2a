"""The engine's own queries by name, and the SQL each must equal."""

from lexmill.plans import corpus, labels, reports, structure

QUERIES = {**corpus.QUERIES, **labels.QUERIES, **structure.QUERIES, **reports.QUERIES}
SQL = {**corpus.SQL, **labels.SQL, **structure.SQL, **reports.SQL}
