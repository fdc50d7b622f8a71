"""fragloom: messy documents to typed, versioned tables on Spark."""
