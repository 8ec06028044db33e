"""Full-text search and analytics on Spark: documents become index tables, and queries become DataFrame plans over them."""
