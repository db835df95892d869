"""Training-data operators: cleaning, deduplicating, mixing and encoding text corpora.

Nothing outside this subpackage imports it; the queries over the shared test tables
are in :mod:`quern.llm.queries`.
"""
