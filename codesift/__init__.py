"""Security audits of source-code corpora as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python batch functions travel to the executors with the job, so the package need not
# be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
