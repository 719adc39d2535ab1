"""Operators of a training-data pipeline: duplicates, contamination, secrets, quality, chat, packing, language models.

Functions of this subpackage that run in Python workers are shipped with their code, so that
executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
