"""cairnkit: a Spark-native knowledge-retrieval engine.

Text processing, chunk storage and retrieval are written as DataFrame to
DataFrame transformations; see README.md for the map of the package.
"""

__version__ = "0.1.0"
