"""liaison: matching two catalogues of entities on Spark.

Relations are long and sparse (`profile(db, entity, term)`, `cost(i, j, cost)`, `plan(i, j, mass)`), so that every
operator is a join, an aggregation or a window that Catalyst can plan, push down and spill.
"""
