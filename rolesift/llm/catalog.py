"""All queries of the subpackage with their SQL, where SQL can express them."""

from __future__ import annotations

from rolesift.llm import (
    bloom_lm,
    dart_minhash,
    hard_negatives,
    license_join,
    mixing,
    packing,
    repeat_intervals,
    signature_search,
    surrogates,
    template_leaks,
    url_cascade,
    warc_bundles,
    weak_quality,
)

MODULES = (
    url_cascade,
    surrogates,
    warc_bundles,
    dart_minhash,
    weak_quality,
    template_leaks,
    repeat_intervals,
    bloom_lm,
    packing,
    license_join,
    signature_search,
    mixing,
    hard_negatives,
)
CATALOG = {name: query for module in MODULES for name, query in module.QUERIES.items()}
