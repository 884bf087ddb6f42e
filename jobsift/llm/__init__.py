"""Training-data operators: PII, packing, chat pairs, HTML main text, licences,
line / exact / SimHash deduplication, quality rules and BPE coding.

Nothing else in the library imports this subpackage.  Its modules are shipped
to executors by value, so that workers need no package install.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
