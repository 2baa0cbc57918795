"""Plan shapes and plumbing: lineage cuts, dense numbering and PageRank."""
