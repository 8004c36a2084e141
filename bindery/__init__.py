"""Web pages to word-budgeted Markdown corpora, as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Python workers get these small helpers with each job; nothing has to be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
