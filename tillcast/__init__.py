"""tillcast: point-of-sale history to daily analytics and sales forecasts, on Spark DataFrames."""
