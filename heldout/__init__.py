"""Evaluation-protocol operators on Spark DataFrames.

Splits without leakage, matched candidate lists, seeded null controls,
fold-local features, cross-fitted probes, entity-first statistics, evidence
weights and audits, all as ordinary Spark joins, windows and aggregations.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
