"""corpusloom: text analytics at corpus scale, expressed as Spark DataFrame plans."""
