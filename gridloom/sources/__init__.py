"""Reading, pruning and writing of gridded tables and vector layers."""
