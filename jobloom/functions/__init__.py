"""Part of the job-posting analytics library."""
