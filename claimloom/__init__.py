"""claimloom: claim-graph analytics, declared as Spark plans.

Atoms (typed claims) and edges (relations between claims) are DataFrames; every
operator is a function from DataFrames to a DataFrame, so that Catalyst sees the
whole plan.  Subpackages:

* ``plans``      building blocks of plans: salted joins, lineage cuts, loaders
* ``functions``  column expressions (text, vectors, JSON)
* ``operators``  relational, graph, vector, audit and consolidation operators
* ``sources``    readers and writers (tables, markdown bundles, reports)
* ``streaming``  incremental ingest with Structured Streaming
* ``queries``    the registered queries and their SQL equivalents
* ``llm``        operators for training-data preparation; nothing else imports it
"""

__version__ = "0.1.0"
