"""touchline: sports analytics operators expressed as Spark DataFrame jobs."""
