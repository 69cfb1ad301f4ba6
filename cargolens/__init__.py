"""Set-based reconciliation of trade dossiers on Spark DataFrames."""
