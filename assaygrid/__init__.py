"""Analytics for feature x sample assay matrices, held as a long cell table on Spark."""

import sys

from pyspark import cloudpickle

# The few pandas functions travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from assaygrid.model import Assay  # noqa: E402

__all__ = ["Assay"]
