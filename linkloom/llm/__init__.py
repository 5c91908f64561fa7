"""Operations of a training-data pipeline: dedup, filters, mixing, packing, search.

Nothing else in the library imports this package.
"""
