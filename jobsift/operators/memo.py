"""Build-once cache for large extractor Columns.

An extractor Column is an immutable expression tree; building it costs many
driver ↔ JVM calls (one per node), so queries of one session that use the
same extractor reuse the tree.  The key is the function, the textual form of
its Column arguments and the active SparkContext.
"""

from __future__ import annotations

import functools
from collections import OrderedDict

from pyspark import SparkContext
from pyspark.sql import Column

#: Columns kept, the ones used last; an extractor's tree takes a few hundred kilobytes in the JVM.
KEPT = 256
_CACHE: OrderedDict = OrderedDict()


def _key_part(v):
    if isinstance(v, Column):
        return ("col", str(v))
    if isinstance(v, dict):
        return ("dict", tuple(sorted(v.items())))
    if isinstance(v, (list, tuple)):
        return ("seq", tuple(_key_part(x) for x in v))
    return ("val", v)


def cached_column(fn):
    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        sc = SparkContext._active_spark_context
        if sc is None:
            return fn(*args, **kwargs)
        # application id + start time: unique per context, unlike id() after a restart
        key = (fn.__module__, fn.__qualname__, sc.applicationId, sc.startTime, tuple(_key_part(a) for a in args),
               tuple(sorted((k, _key_part(v)) for k, v in kwargs.items())))
        hit = _CACHE.get(key)
        if hit is None:
            hit = fn(*args, **kwargs)
            _CACHE[key] = hit
            if len(_CACHE) > KEPT:
                _CACHE.popitem(last=False)
        else:
            _CACHE.move_to_end(key)
        return hit

    return wrapper
