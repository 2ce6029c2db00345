"""Search, scoring and audits over large collections of cataloged containers, as Spark DataFrames."""
