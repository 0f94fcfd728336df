"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; ``queries`` registers one
query per operator and ``corpus_pipeline.py`` (repository top) chains five of
them.  Shared helpers: ``batches`` (Arrow batches as byte arrays and their
vectorised hashes), ``linear`` (hashed logistic models), ``components``
(connected components on Spark) and ``storage`` (checkpoints).
"""
