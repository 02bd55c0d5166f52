"""The corpus operators' queries and checking SQL."""

from gaugeworks.llm import (
    bpe, conversations, embeddings, licences, mixing, quality, rules, simhash, sketches, substrings,
    token_files, token_rollup, whitening,
)

_MODULES = [
    token_rollup, simhash, embeddings, token_files, substrings, bpe, quality, sketches, licences,
    mixing, whitening, conversations, rules,
]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
