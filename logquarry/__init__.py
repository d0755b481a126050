"""Root-cause analysis over service logs, expressed as Spark DataFrame operators.

Packages:

* ``sources``   - log files, the document table, the feature snapshot and its manifest
* ``functions`` - column expressions (parsing, text, time, vectors, labels)
* ``operators`` - DataFrame -> DataFrame operators (order, windows, search, issues, metrics)
* ``plans``     - compositions: all features, ingest, issue analysis
* ``streaming`` - Structured Streaming jobs built from the same functions
* ``catalog``   - the queries that ``__spark_entry__`` registers, each with its SQL check
"""

import sys

from pyspark import cloudpickle

# Tasks carry the functions they need by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
