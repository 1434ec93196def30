"""The modules whose queries are registered."""

from sigtrail.llm import decontaminate, exact_dedup, hard_negatives, html_extract, jaccard_join, language_id, license_scan, line_dedup, merkle_manifest, piece_codec, quality_rules, secret_scan, token_count

MODULES = [line_dedup, secret_scan, token_count, html_extract, piece_codec, license_scan, decontaminate, exact_dedup, language_id, jaccard_join, merkle_manifest, hard_negatives, quality_rules]
