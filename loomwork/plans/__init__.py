"""Session defaults, table access and lineage cuts that every operator shares."""
