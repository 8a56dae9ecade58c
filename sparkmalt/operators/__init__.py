"""DataFrame operators: classification, validation, repair, deduplication, mapping, extraction, change capture."""
