"""Training-data operators: license scans, mixing, deduplication, language ID, packing and more.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query an operator.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run on executors travel with their code: workers need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
