"""Operations of a large-scale training-data pipeline.

Nothing outside this subpackage imports it, so it can be left out. Every operator takes and returns
DataFrames; rows that share an id are told apart by content, null texts count as empty texts.
"""
