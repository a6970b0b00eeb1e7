"""Media triage over tables of files, outcomes and findings, expressed in Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from mediasift.params import Params

# workers get the code of plug-ins and stream state with their tasks and need no import path
register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params"]
