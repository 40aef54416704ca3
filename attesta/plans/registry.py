"""All registered queries with the SQL they are checked against."""
from attesta.plans import oracle_evidence, oracle_reports, queries_evidence, queries_files, queries_reports

QUERIES = {**queries_evidence.QUERIES, **queries_reports.QUERIES, **queries_files.QUERIES}
ORACLE = {**oracle_evidence.ORACLE, **oracle_reports.ORACLE, **queries_files.ORACLE}
