"""Credit-risk features and default modelling as Spark DataFrame jobs."""
