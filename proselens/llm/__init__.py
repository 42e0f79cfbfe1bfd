"""Operations of a training-data pipeline: scoring, filtering, deduplication, extraction and archiving.

Nothing else in the library imports this subpackage.
"""
