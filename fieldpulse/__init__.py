"""fieldpulse: portfolio analytics for field activities and studies on Spark.

Sub-packages: ``sources`` (reading, landing, catalog), ``functions`` (reusable
Column expressions), ``operators`` (cleaning, brief, risks, catalogue, text
operators, reports), ``plans`` (named-query registry and oracle SQL) and
``streaming`` (incremental refresh).
"""

__version__ = "0.1.0"
