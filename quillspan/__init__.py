"""quillspan: document-structure analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
