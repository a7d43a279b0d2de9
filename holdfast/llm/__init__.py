"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions of this subpackage travel to the executors by value, so a cluster needs only the
public libraries that an operator names, not an installed copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
