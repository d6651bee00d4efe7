"""Cohort and outcome studies on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from cohortry.roles import ColumnRoles
from cohortry.session import build_session, shared_dir

__all__ = ["ColumnRoles", "build_session", "shared_dir"]

# functions inside UDFs travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
