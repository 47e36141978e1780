"""lodestar: Spark-native counterfactual distillation.

Explains a binary tabular classifier with ordinary DataFrame operators:
feature preparation, scoring, a distributed counterfactual search,
attributions, change encoding, K-Means, rule distillation and the
analytical queries over the resulting artifact tables.
"""

import sys

from pyspark import cloudpickle

from lodestar.spec import CaseSpec, ORDER_CASES, DOCUMENT_CASES

# code that runs in tasks travels with its closure, so executors need no
# copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CaseSpec", "ORDER_CASES", "DOCUMENT_CASES"]
