"""Training-data pipeline operators: one module per operator, shared word
helpers in ``words``, registered queries in ``queries``.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
