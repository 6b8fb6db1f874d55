"""Training-data operators: quality, rules, archives, packing, duplicates, language model, secrets, decontamination, extraction.

Nothing else in the library imports this subpackage. Its functions are sent to the executors by value, so workers need
no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
