"""All registered queries and their SQL."""

from weekrank.queries import cleaning, fitting, joining, landing, modelling, profiling, weekly

QUERIES: dict = {}
SQL: dict = {}
for _module in (weekly, cleaning, joining, profiling, modelling, fitting, landing):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
