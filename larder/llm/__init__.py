"""Operators for preparing language-model training data, one module each, with their registered queries.

Nothing outside this subpackage imports it. Functions that run in Python workers are shipped by value,
so an executor needs no installed copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
