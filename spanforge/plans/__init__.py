"""All queries of the engine over the test tables, and the SQL that each is held against."""

from . import advice, analytics, ledger, lexicon, more, quality, spans, stored, streams

_PARTS = (spans, ledger, analytics, quality, streams, advice, more, stored, lexicon)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
