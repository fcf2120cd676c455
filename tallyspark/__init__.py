"""tallyspark: Spark-native processing of tabulated count data.

Count data arrives as one row per reporting unit (a *station*) with either one
column per category (*wide*) or one row per station and category (*long*).
The library brings both shapes to one long table, rebuilds missing totals,
pivots to shares, reconciles raw and clean rows, runs data-quality checks and
fits PCA / CCA with the heavy sums on the cluster.

Every operator is a function of DataFrames and column names that returns a
DataFrame; nothing is collected except the small feature-by-feature matrices
of the statistics module and schema / file listings.
"""

__version__ = "0.1.0"
