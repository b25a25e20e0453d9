"""corpusloom: literature retrieval analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames (or Columns) and leaves the
physical strategy to Catalyst; see README.md for the map of modules.
"""

__version__ = "0.1.0"
