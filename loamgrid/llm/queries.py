"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from . import embeddings, hard_negatives, jaccard, language_model, packing, pieces, quality, resampling, rules, secrets, substrings, token_files, toxicity

_MODULES = [token_files, packing, substrings, rules, toxicity, quality, language_model, embeddings, pieces, jaccard, resampling, secrets, hard_negatives]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
