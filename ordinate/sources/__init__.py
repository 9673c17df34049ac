"""Storage: versioned directories, their log, and what a version looks like to Spark."""
