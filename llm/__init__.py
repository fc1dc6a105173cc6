"""Operators of a training-data pipeline: deduplication, scoring, language, packing, mixing, sharding, joins.

Nothing else in the repository imports this package. On a cluster ship it with the job (``--py-files``); tasks import it.
"""
