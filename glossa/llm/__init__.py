"""Operators for building training data from large text corpora.

Nothing else in the library imports this subpackage.  Python code that runs in
tasks is shipped by value, so executors do not need the package installed.
"""
import importlib

from pyspark import cloudpickle

#: Modules whose functions run in tasks.
_SHIPPED = ("chargram", "common", "decontam", "fptree", "html", "packing", "parttrie", "simhash", "toxicity", "urls")

for _name in _SHIPPED:
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
