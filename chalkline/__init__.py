"""chalkline: time-aligned lecture analytics and corpus preparation on Spark."""
