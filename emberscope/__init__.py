"""CPU-profile analytics on Spark: browse, aggregate, compare and drill into V8 call-tree profiles.

``emberscope.plans.engine.Engine`` answers questions about stored profiles; ``emberscope.operators``
holds the DataFrame operators it is made of.  Functions that run on executors are pickled by
value, so a cluster needs no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
