"""Fleet-wide scene measurement on Spark: depth frames in, graded heights out.

Every operator takes and returns DataFrames keyed by ``run_id``; nothing here
runs an action except the sinks and the two fixpoint loops (connected voxels
and lineage closure).
"""
