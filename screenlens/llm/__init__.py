"""Training-data operators: one module per operator, their queries in ``queries`` and SQL twins in ``oracle``.

Nothing outside this folder imports it, apart from ``corpus_pipeline.py`` and the guarded lines of
``__spark_entry__.py``.
"""
