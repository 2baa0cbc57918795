"""Graph operators: transforms, statistics, partitioning, generators and log analytics."""
