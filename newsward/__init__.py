"""newsward: ESG news monitoring expressed as Spark DataFrame jobs."""
