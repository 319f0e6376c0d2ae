"""varloom: interval, k-mer and graph genotyping operators on Spark DataFrames."""
