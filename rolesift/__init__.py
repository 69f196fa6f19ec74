"""rolesift: job-posting analytics as Spark jobs.

Landed career pages go in; scored, deduplicated postings, a ranked digest and
run accounting come out. Everything is ``DataFrame -> DataFrame``.
"""

import sys

from pyspark import cloudpickle

# the Arrow functions travel to the executors by value, so a cluster needs no
# copy of this package and no working folder in common
cloudpickle.register_pickle_by_value(sys.modules[__name__])
