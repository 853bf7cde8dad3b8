"""Text and activity governance as Spark jobs.

Every operator takes a DataFrame and returns a DataFrame (or a Column), so it
composes with ``df.transform`` and stays inside one Catalyst plan.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions travel inside the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
