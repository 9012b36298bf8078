"""Every query of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quillon.llm import bpe, chat, language, lattice, multiindex, packing, pii, secrets, simhash, substrings

QUERIES = bpe.QUERIES | chat.QUERIES | language.QUERIES | lattice.QUERIES | multiindex.QUERIES | packing.QUERIES | pii.QUERIES | secrets.QUERIES | simhash.QUERIES | substrings.QUERIES
ORACLES: dict[str, str] = chat.ORACLES
