"""vetgrid: security analytics over source code held in Spark tables.

Every operator takes DataFrames and returns DataFrames; nothing is executed until
the caller runs an action or one of the writers in :mod:`vetgrid.plans`.
"""

__version__ = "0.1.0"
