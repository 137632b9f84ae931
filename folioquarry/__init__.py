"""folioquarry: a Spark-first engine for document libraries.

Sub-packages: ``sources`` (files in), ``functions`` (column expressions),
``operators`` (relational and fold operators), ``plans`` (composed queries and
the tool API), ``streaming`` (incremental ingest).  ``llm`` is optional and
nothing outside it imports it.
"""
