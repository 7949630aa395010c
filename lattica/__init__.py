"""Lattica: organisational-knowledge analytics expressed as Spark plans.

Documents are chunked, mined for entities and relations, reviewed by people,
loaded into a property graph, and searched by vector, graph and keyword at
once under row-level access control.  Every stage takes DataFrames and returns
a lazy DataFrame.
"""

import sys

from pyspark import cloudpickle

# Arrow functions of this package travel to the executors inside the task, so a
# cluster needs no separate installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
