"""Count before you build: data harmonization checks and models on Spark.

Every measurement is a Spark aggregate over whole tables. What comes back to
the driver is bounded by the number of columns, keys columns or steps, never
by the number of rows.
"""
