"""promolith: promotion-price analytics and corpus tooling on Spark DataFrames."""
