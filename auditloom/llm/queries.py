"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, decontaminate, langid, licences, lines, media, mix, prefix_trie, runs, secrets, simhash, toxicity, wavelet_tokens

_MODULES = [decontaminate, langid, secrets, toxicity, licences, simhash, media, lines, wavelet_tokens, mix, runs, prefix_trie, byte_bpe]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
