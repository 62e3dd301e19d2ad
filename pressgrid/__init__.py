"""pressgrid: article metadata from URL lists and stored pages, as Spark jobs.

Column functions live in ``pressgrid.functions``, DataFrame operators in
``pressgrid.operators``, file sources and sinks in ``pressgrid.sources``, the
URL pipeline and the registered queries in ``pressgrid.plans`` and the
Structured Streaming jobs in ``pressgrid.streaming``.
"""

__version__ = "0.1.0"
