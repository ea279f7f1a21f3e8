"""Operators for preparing training data; nothing else in the library imports them."""

from pyspark import cloudpickle

import latewing

# Functions travel to the workers by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(latewing)
