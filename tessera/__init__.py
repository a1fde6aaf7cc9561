"""tessera: code-context analytics and corpus preparation as Spark DataFrame plans."""
