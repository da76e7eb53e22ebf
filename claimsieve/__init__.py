"""Claims-risk analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames.  Parameters that depend on the data (bin edges, rule coefficients,
medians) travel as one-row scalar subqueries, so a plan stays lazy and no claim row ever reaches the driver.
"""

__version__ = "0.1.0"
