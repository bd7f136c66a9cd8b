"""Operators for preparing training data; nothing else in the library imports them.

Their Python functions are pickled by value, so that executors need no copy of the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
