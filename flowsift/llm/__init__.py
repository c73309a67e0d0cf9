"""Operators for preparing training text.  Nothing outside this folder imports it."""

from pyspark import cloudpickle

import flowsift

# ship the functions with the tasks: workers need not have the package installed
cloudpickle.register_pickle_by_value(flowsift)
