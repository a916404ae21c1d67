"""Spark-native analytics for location-tagged price listings.

Every public operator takes DataFrames (plus literal settings) and returns DataFrames; Catalyst and AQE pick
the physical plan.
"""

__version__ = "0.1.0"
