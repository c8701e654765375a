"""lendscope: credit-decision analytics on Spark.

Raw bank extracts are typed and recoded, child tables are rolled up to one
row per account (over all history, or only before the account's loan), the
rollups are joined into a feature mart, and the mart feeds seeded, bagged
`pyspark.ml` models whose averaged scores are turned into threshold tables,
reports, histograms and pre-approve / approve / deny tiers.

Sub-packages
------------
sources    extract readers, lenient typing, mart sinks, test-table stand-ins
functions  scalar column helpers (dates, recodes, birth numbers, casts)
operators  relational building blocks (dedup, cutoff join, rollups, links)
plans      end-to-end plans (marts, feature prep, models, decisions)
streaming  scoring of new accounts as they arrive
"""

__version__ = "0.1.0"
