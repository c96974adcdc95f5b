"""Column expressions: they take and return Columns and never trigger a job."""
