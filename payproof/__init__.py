"""payproof: accounts-payable audit checks as Spark DataFrame jobs."""
