"""Multi-width lexical analytics of row vectors and the text attached to them, on Spark DataFrames."""
