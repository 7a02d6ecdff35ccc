"""Sources and sinks: FASTA, tables, lineage, atomic publication."""
