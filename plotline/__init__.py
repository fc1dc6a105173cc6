"""Build, check and score question benchmarks over ordered text sequences, on Spark DataFrames."""
