"""lotwise: listing appraisal on Spark.

DataFrame operators, Column functions and streaming jobs that turn captured
marketplace listings, completed sales and price catalogues into identities,
fair values, economics, gates and ranked decision tables.
"""
