"""gleaner: content curation as Spark table transformations."""

import sys

from pyspark import cloudpickle

# The few Python workers (HTML walking, NFKD, scorers) carry their helpers with
# them, so executors need no separate installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
