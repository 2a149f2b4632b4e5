"""Operators and queries of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when the
subpackage is present.
"""

import sys

from pyspark import cloudpickle

# Python workers need not have this repository on their path: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
