"""Market analytics for thinly traded goods, as Spark DataFrame jobs."""
