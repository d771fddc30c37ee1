"""A Spark-native engine for collections of assembled genomes, with tools for training data in ``strandlake.llm``."""
