"""Record analytics on Spark: listings in, linked and ranked records out."""
