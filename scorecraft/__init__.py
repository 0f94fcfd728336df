"""scorecraft: evaluation analytics for language-model outputs on Spark.

Every public function takes and returns DataFrames; nothing is collected to
the driver.  See README.md for the module map.
"""

import sys as _sys

__version__ = "0.1.0"

# The few Python UDFs (parse ladder, LCS pass, YAML catalogue) are shipped to
# the Python workers by value, so executors need no installed copy of this
# package and no --py-files.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the hook
    pass
