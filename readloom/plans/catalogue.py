"""All queries of the core library and the SQL that checks them."""

from readloom.plans import general, general_sql, more, more_sql, reference, reference_sql

QUERIES = reference.QUERIES | more.QUERIES | general.QUERIES
ORACLES = reference_sql.ORACLES | more_sql.ORACLES | general_sql.ORACLES
