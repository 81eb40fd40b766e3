"""All registered queries and their SQL twins, by name."""

from __future__ import annotations

from . import casework, feeds, flows, ledgers, nightly, reading, records, reports

QUERIES = {**reading.QUERIES, **casework.QUERIES, **nightly.QUERIES, **reports.QUERIES, **records.QUERIES, **flows.QUERIES, **ledgers.QUERIES, **feeds.QUERIES}
ORACLE_SQL = {**reading.ORACLE_SQL, **casework.ORACLE_SQL, **nightly.ORACLE_SQL, **reports.ORACLE_SQL, **records.ORACLE_SQL, **flows.ORACLE_SQL, **ledgers.ORACLE_SQL, **feeds.ORACLE_SQL}
