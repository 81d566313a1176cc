"""Spark-native private text analytics engine.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame
operators), ``plans`` (registered queries and their SQL), ``sources`` (readers,
writers, run logs), ``streaming`` (Structured Streaming) and the optional
``llm`` (training-data operators), which nothing else here imports.
"""

__version__ = "0.1.0"
