"""Sports and media analytics on Spark: DataFrame, streaming and MLlib operators."""
