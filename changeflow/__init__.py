"""changeflow: change-data-capture and training-data operators for PySpark.

Every operator takes and returns DataFrames and stays lazy unless its
docstring says that it writes (state versions, versioned tables).
"""

__version__ = "0.1.0"
