"""Price-panel and portfolio analytics as plain Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame, and no table is
collected to the driver. Operators run when the caller runs an action, except
``optimize.solve_large``, which iterates and checkpoints as it goes; the
registered queries also checkpoint estimates that they use several times.
"""

__version__ = "0.1.0"
