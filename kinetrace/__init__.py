"""Analytics over observation, session and member data, expressed as Spark DataFrames."""
