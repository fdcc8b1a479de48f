"""A PySpark analytics engine that turns semi-structured application records into reviewed, versioned, queryable knowledge."""
