"""termlens — term statistics over large text collections, expressed as Spark jobs.

Sub-packages:

* ``functions`` — Column-expression builders (ASCII folding, cleaning, stemming,
  lemma rules, bibliography field parsing).  No Python UDFs.
* ``sources``   — readers/writers for corpora, snippet tables and result tables.
* ``operators`` — the DataFrame jobs: snippet extraction, co-occurrence, corpus
  statistics, TF-IDF, bibliography, table maintenance, neighbours, information
  measures and word networks.
* ``plans``     — the registered queries (Spark side) and their DuckDB oracles.
* ``streaming`` — incremental runs over newly arriving documents.
"""

__version__ = "0.1.0"
