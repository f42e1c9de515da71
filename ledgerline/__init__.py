"""Reports, profiling, imputation and classification for flat labelled tables on Spark."""
