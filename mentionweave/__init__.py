"""Company-mention resolution on Spark."""
