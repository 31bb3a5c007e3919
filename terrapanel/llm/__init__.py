"""Operators for large-scale training-data preparation.

Nothing outside this package imports it.  ``queries.QUERIES`` maps the names
``opN_<name>`` to callables ``(spark, data_dir) -> DataFrame`` and
``queries.ORACLES`` holds DuckDB SQL for those that SQL can express.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
