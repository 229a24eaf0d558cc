"""tukeyframe: outlier analytics on Spark DataFrames (exact, histogram and textbook 1.5 IQR flags)."""
