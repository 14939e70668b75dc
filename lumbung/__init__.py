"""lumbung: corpus retrieval, media analytics and corpus preparation on Spark."""
