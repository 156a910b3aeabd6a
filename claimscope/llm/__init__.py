"""Operations of a training-data pipeline over web documents."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions with the job, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
