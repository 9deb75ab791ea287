"""Cairnlake: a Spark-native file catalog engine with training-data operators.

The catalog part lives in ``catalog``, ``dsl``, ``operators``, ``sources``,
``functions``, ``plans`` and ``streaming``.  The corpus operators live in
``llm``, which nothing else in the package imports.
"""
