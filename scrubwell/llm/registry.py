"""Every query of the subpackage and its SQL, by name."""

from scrubwell.llm import bpe, decontaminate, langid, pii, quality, simhash, substrings, token_counts, toxicity, warc

MODULES = (bpe, token_counts, langid, warc, substrings, decontaminate, simhash, pii, toxicity, quality)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
