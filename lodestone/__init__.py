"""lodestone: retrieval, routing, arbitration and evaluation of question batches as Spark DataFrames."""
