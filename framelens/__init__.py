"""framelens: content analysis of news articles on Spark DataFrames."""
