"""harrow: posting discovery analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame.  Nothing is collected to the driver except scalar loop counters.
"""

__version__ = "0.1.0"
