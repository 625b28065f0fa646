"""Analytics over generated programs, their plans and their verdicts, on Spark DataFrames."""
