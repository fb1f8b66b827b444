"""Table operators for documents, embeddings and model output, on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Worker processes need no installed copy of the package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
