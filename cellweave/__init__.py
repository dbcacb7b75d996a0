"""Set-based operators over adaptively refined cell tables, and over training corpora, on Spark DataFrames."""
