"""quirelake: document analytics expressed as Spark DataFrames."""
