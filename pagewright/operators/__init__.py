"""Operators on words, regions, tables, pixels and blocks: DataFrame in, DataFrame out."""
