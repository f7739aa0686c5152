"""Operators for preparing language-model training text at scale.

Nothing else in the library imports this package.  Functions that run on
executors are shipped by value, so a cluster needs only numpy, pyarrow, pandas,
zstandard and (for token output) the tokenizers library on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
