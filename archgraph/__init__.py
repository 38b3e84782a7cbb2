"""archgraph: software architecture and training data analysed with PySpark DataFrames."""
