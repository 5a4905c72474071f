"""evalloom: corpus preparation and model-evaluation analytics as Spark jobs.

``functions``  Column -> Column building blocks (text, tokens, filters, scores)
``operators``  DataFrame -> DataFrame operators (decontamination, packing, roll-ups ...)
``sources``    readers and writers
``streaming``  Structured Streaming forms of the batch operators
``plans``      the catalogue of registered queries with their SQL oracles
"""

__version__ = "0.1.0"
