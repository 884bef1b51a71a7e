"""codesieve: code-security findings as Spark DataFrames."""
