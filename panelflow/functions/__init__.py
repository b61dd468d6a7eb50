"""Column expressions (scalar functions).  All of them return Spark
``Column`` objects built from built-ins, so they stay inside whole-stage
codegen; none is a Python UDF."""

from panelflow.functions.numeric import np_round, safe_div, to_num, first_non_null  # noqa: F401
