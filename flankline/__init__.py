"""flankline: ordered-neighbourhood analytics on Spark DataFrames."""
