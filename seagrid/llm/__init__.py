"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. ``queries`` in
``seagrid.llm.registry`` lists one registered query per operator.
"""
