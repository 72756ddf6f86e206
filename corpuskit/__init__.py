"""corpuskit: DataFrame operators that curate, measure and compile text corpora on Spark."""
