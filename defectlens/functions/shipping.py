"""Send a module's functions to the executors by value.

Executors then need pyarrow and the standard library only, not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
