"""Fleet reporting and series transforms as Spark DataFrame jobs."""
