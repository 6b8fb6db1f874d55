"""docpipe: extracted business documents to a trustworthy analytics table, as Spark jobs.

Sub-packages
------------
``functions``  column expressions (``Column -> Column``)
``sources``    readers and arrival-event decoding
``operators``  set-based transforms (``DataFrame -> DataFrame``)
``plans``      whole stages: silver, gold, batch, metrics, questions, sinks
``streaming``  the same stages driven by Structured Streaming
"""
