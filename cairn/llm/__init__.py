"""Training-data operators: each works on whole tables as Spark jobs; nothing else in the library imports this package."""
