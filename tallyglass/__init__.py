"""tallyglass: an automated data analyst whose every step is a Spark job."""
