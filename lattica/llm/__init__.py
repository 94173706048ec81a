"""Operations for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  ``lattica.llm.registry`` lists the
queries and their SQL twins.
"""
