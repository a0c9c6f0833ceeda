"""Operators of a training-data pipeline (search, packing, deduplication,
mixing, fingerprints, chat formatting, quality ranking).

Nothing else in the library imports this subpackage; ``__spark_entry__``
adds its queries when it is there.  Functions that run inside Spark's
Python workers are shipped with the job (pickled by value), so executors
need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
