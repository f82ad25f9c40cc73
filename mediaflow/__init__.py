"""mediaflow: PySpark jobs over media-transport captures, reports, sessions and signalling logs."""
