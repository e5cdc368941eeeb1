"""porespark: transport in segmented 3-D porous media, as Spark DataFrame plans.

Every operator is ``DataFrame -> DataFrame``.  The sample key ``ms_id`` leads
every table, but no operator relies on one sample fitting in one task.
"""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
