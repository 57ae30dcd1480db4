"""Land cover per cadastral parcel as Spark DataFrame jobs."""
