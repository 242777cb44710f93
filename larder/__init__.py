"""Order, menu, pricing, promotion, rating, inventory and wastage analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame. Nothing here registers a user-defined
function: the work stays in Spark SQL expressions, joins, aggregates, windows and MLlib.
"""
