"""Code-intelligence analytics over facts about software, as Spark DataFrames."""
