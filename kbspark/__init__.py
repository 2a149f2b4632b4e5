"""kbspark: document knowledge-base building and querying as Spark DataFrame functions.

Every public function takes DataFrames (plus plain parameters) and returns a DataFrame, so a
whole knowledge-base job stays one lazy plan that Catalyst can prune, push down and re-plan.
"""

import sys

from pyspark import cloudpickle

from kbspark.session import get_session, checkpoint_dir

# Python workers need not have this repository on their path: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "checkpoint_dir"]
